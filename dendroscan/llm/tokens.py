"""Encoding of documents, and exact statistics of their lengths."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import END_OF_WORD, NOT_SPACE, WordBpe, chunks, pieces
from .common import at_work, in_batches, remembers, small_batches, tokenizer_source


#: Chunks of so many bytes are remembered in arrays: the bytes and their number make two words of 64 bits.
SHORT = 15


def _gathered(flat, begins, sizes):
    """The runs of ``flat`` that begin at ``begins``, one after the other."""
    import numpy as np

    ends = np.cumsum(sizes)
    return flat[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class _Known:
    """Ids of short chunks by their two words, in a hash table of arrays: many are looked up in one step, and each takes a
    fraction of the memory that a dictionary of strings does. Words are compared as a whole, so nothing depends on hashes."""

    def __init__(self, room: int = 1 << 12):
        import numpy as np

        self.n, self.room = 0, room  # room: a power of two
        self.first, self.second = np.empty(room, np.uint64), np.empty(room, np.uint64)
        self.ends = np.zeros(room + 1, np.int64)
        self.ids = np.empty(4 * room, "<u4")
        self.slots = np.full(2 * room, -1, np.int32)

    def _slot(self, first, second):
        import numpy as np

        mixed = (first ^ second * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, first, second):
        """The entry of each chunk, or -1."""
        import numpy as np

        out, asks, at = np.full(len(first), -1, np.int64), np.arange(len(first)), self._slot(first, second)
        while len(asks):
            entry = self.slots[at]
            same = (entry >= 0) & (self.first[entry] == first) & (self.second[entry] == second)
            out[asks[same]] = entry[same]
            on = (entry >= 0) & ~same
            asks, at, first, second = asks[on], (at[on] + 1) & (len(self.slots) - 1), first[on], second[on]
        return out

    def _settle(self, low: int) -> None:
        """Gives a slot to each entry from ``low`` on."""
        import numpy as np

        entries, at = np.arange(low, self.n, dtype=np.int32), self._slot(self.first[low : self.n], self.second[low : self.n])
        while len(entries):
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]
            lost = self.slots[at] != entries
            entries, at = entries[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def aside(self, ids) -> int:
        """Where some ids lie in ``ids`` until the next are added."""
        import numpy as np

        used = int(self.ends[self.n])
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[:used], np.empty(max(used // 2, 2 * len(ids)), "<u4")))
        self.ids[used : used + len(ids)] = ids
        return used

    def add(self, first, second, sizes, ids):
        """The new entries of different chunks that aren't there."""
        import numpy as np

        low, end = self.n, self.n + len(first)
        if grown := end > self.room:
            while end > self.room:
                self.room *= 2
            for name in ("first", "second"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate((old[:low], np.empty(self.room - low, np.uint64))))
            self.ends = np.concatenate((self.ends[: low + 1], np.zeros(self.room - low, np.int64)))
            self.slots = np.full(2 * self.room, -1, np.int32)
        self.first[low:end], self.second[low:end] = first, second
        self.ends[low + 1 : end + 1] = self.aside(ids) + np.cumsum(sizes)
        self.n = end
        self._settle(0 if grown else low)
        return np.arange(low, end)


class ChunkIds:
    """Ids of texts, where each word is encoded once while it is remembered.

    For a file whose tokens hold no white space and whose words end in a token of their own kind, a text's ids are
    those of its chunks between white space, and a chunk's those of its words. ``bound`` short chunks in each of two
    generations, half as many words and a sixteenth as many long chunks are kept; this bounds memory and changes no result.
    """

    def __init__(self, special: list[str], bound: int = 300_000):
        self.special, self.bound = special, bound
        self.new, self.old = _Known(), _Known()
        self.long: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of some words as pieces() gives them."""
        raise NotImplementedError

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of a chunk that holds a special token."""
        raise NotImplementedError

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of chunks that aren't remembered."""
        known, split, whole = self.words, [], {}
        if len(known) > self.bound // 2:
            known.clear()
        for c in words:
            if "<" in c and any(x in c for x in self.special):
                whole[len(split)] = self.encode_chunk(c)
                split.append(())
            else:
                split.append((c.lower(),) if c.isascii() and c.isalpha() else pieces(c))
        more = list({w for parts in split for w in parts if w not in known})
        known.update(zip(more, self.encode_words(more), strict=True))
        out = [known[parts[0]] if len(parts) == 1 else b"".join([known[w] for w in parts]) for parts in split]
        for at, blob in whole.items():
            out[at] = blob
        return out

    def _long(self, words: list[str]) -> list[bytes]:
        """Ids of some different long chunks."""
        known = self.long
        if len(known) > self.bound // 16:
            known.clear()
        miss = [w for w in words if w not in known]
        known.update(zip(miss, self._learn(miss), strict=True))
        return [known[w] for w in words]

    def _places(self, words):
        """Of some different chunks, an Arrow array: ids, and where in these each chunk's begin and how many there are."""
        import numpy as np
        import pyarrow as pa

        if self.new.n > self.bound:
            self.old, self.new = self.new, _Known()
        new, old = self.new, self.old
        words = words.cast(pa.large_string())
        bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
        data = np.concatenate((np.frombuffer(words.buffers()[2] or b"", np.uint8)[: bounds[-1]], np.zeros(16, np.uint8)))
        eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the 8 bytes from each byte on
        low = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
        lengths = np.diff(bounds)
        short = np.flatnonzero(lengths <= SHORT)
        at, n = bounds[short], lengths[short]
        first = eights[at] & low[np.minimum(n, 8)]
        second = eights[at + 8] & low[np.maximum(n - 8, 0)] | n.astype(np.uint64) << np.uint64(56)
        entry = new.find(first, second)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            was = old.find(first[miss], second[miss])
            again, was, miss = miss[was >= 0], was[was >= 0], miss[was < 0]
            if len(again):
                sizes = old.ends[was + 1] - old.ends[was]
                entry[again] = new.add(first[again], second[again], sizes, _gathered(old.ids, old.ends[was], sizes))
            for part in np.array_split(miss, -(-len(miss) // 100_000)) if len(miss) else ():  # strings of some at a time
                blobs = self._learn(words.take(pa.array(short[part])).to_pylist())
                sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) >> 2
                entry[part] = new.add(first[part], second[part], sizes, np.frombuffer(b"".join(blobs), "<u4"))
        begins, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        begins[short], sizes[short] = new.ends[entry], new.ends[entry + 1] - new.ends[entry]
        if len(short) < len(words):
            long = np.flatnonzero(lengths > SHORT)
            blobs = self._long(words.take(pa.array(long)).to_pylist())
            sizes[long] = np.fromiter(map(len, blobs), np.int64, len(blobs)) >> 2
            begins[long] = new.aside(np.frombuffer(b"".join(blobs), "<u4")) + np.cumsum(sizes[long]) - sizes[long]
        return new.ids, begins, sizes

    def texts(self, texts, at_once: int = 1000) -> Iterator:
        """Ids of each text, an array of uint32; a null text is an empty one. ``texts``: Arrow strings or a list. Arrow
        splits them and numbers their different chunks, so that only these are looked up in Python."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        column = pc.fill_null(column, "")
        start = 0
        while start < len(column):
            some, size = column.slice(start, at_once), at_once
            while size > 1 and some.nbytes > 32 << 20:  # very long texts
                size //= 4
                some = column.slice(start, max(size, 1))
            start += len(some)
            if pc.any(pc.match_substring_regex(some, f"[{NOT_SPACE}]")).as_py():  # Arrow parts words there, the tokenizer doesn't
                split = pa.array([chunks(t) for t in some.to_pylist()], pa.list_(pa.string()))
            else:
                split = pc.utf8_split_whitespace(some)
            coded = split.flatten().dictionary_encode()
            flat, begins, sizes = self._places(coded.dictionary)
            which = coded.indices.to_numpy()
            n = sizes[which]
            ends = np.concatenate(([0], np.cumsum(n)))
            ids = flat[np.repeat(begins[which] - ends[:-1], n) + np.arange(ends[-1])]
            bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
            for a, b in zip(bounds, bounds[1:], strict=False):
                yield ids[a:b]


class LibraryIds(ChunkIds):
    """Words are encoded by the tokenizers library, many at a time; the ends of words part their ids."""

    def __init__(self, source: str, bound: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.source, self.plain = source, Tokenizer.from_str(source)
        self.plain.no_truncation()
        self.plain.no_padding()
        super().__init__([t.content for t in self.plain.get_added_tokens_decoder().values()], bound)
        self.plain.model._clear_cache()
        self.plain.model._resize_cache(0)  # no word comes twice
        # what pieces() gives is composed, in lower case and split: a space is all there is left to do
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.plain.get_vocab_size() + 1, bool)
        for t, i in self.plain.get_vocab().items():
            self.ends[i] = t.endswith(END_OF_WORD)
        self.whole = None

    def _ids(self, text: str, tokenizer):
        import numpy as np

        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def encode_words(self, words: list[str]) -> list[bytes]:
        import numpy as np

        out = []
        for at in range(0, len(words), 512):
            some = words[at : at + 512]
            ids = self._ids(" ".join(some), self.plain)
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(some):
                raise ValueError("the tokenizer's words don't end in tokens of their own kind")
            blob, start = ids.tobytes(), 0
            for end in ends:
                out.append(blob[start:end])
                start = end
        return out

    def encode_chunk(self, chunk: str) -> bytes:
        if self.whole is None:  # rarely needed
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_str(self.source)
            self.whole.no_truncation()
            self.whole.no_padding()
        return self._ids(chunk, self.whole).tobytes()


class AutomatonIds(ChunkIds):
    """Words are encoded along the automaton's paths."""

    def __init__(self, source: str, bound: int = 300_000):
        self.bpe = WordBpe(source)
        super().__init__(list(self.bpe.special), bound)

    def encode_words(self, words: list[str]) -> list[bytes]:
        return [self.bpe.encode_word(w) for w in words]

    def encode_chunk(self, chunk: str) -> bytes:
        return self.bpe.encode_chunk(chunk)


@lru_cache(maxsize=2)
def library(source: str) -> LibraryIds:
    """One per Python worker and tokenizer file."""
    return _settled(LibraryIds(source))


remembers("tokens", library.cache_clear)


@lru_cache(maxsize=2)
def automaton(source: str) -> AutomatonIds:
    """One per Python worker and tokenizer file."""
    return _settled(AutomatonIds(source))


remembers("automaton", automaton.cache_clear)


def _settled(made):
    import gc

    gc.freeze()  # the tables stay: no need to look through them again and again
    gc.set_threshold(1_000_000, 50, 50)  # lists of words hold no cycles
    return made


def encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``ids`` (binary: little-endian uint32) and ``decoded`` (string), by the merge automaton.

    A null text is an empty one; null or repeated ids are passed through; an empty table gives no rows; other
    columns are ignored. ``tokenizer``: path of the tokenizer file, read on the driver.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    source = tokenizer_source(tokenizer)
    kind = df.schema[id_col].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches):
        at_work("automaton")
        words = automaton(source)

        def rows():
            for batch in batches:
                for i, ids in zip(batch.column(0).to_pylist(), words.texts(batch.column(1)), strict=True):
                    blob = ids.tobytes()
                    yield i, blob, words.bpe.decode(blob)

        yield from in_batches(rows(), schema, lambda r: len(r[1]) + len(r[2]))

    return small_batches(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, ids binary, decoded string")


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` for a column of id blobs; null ids decode to an empty text."""
    source = tokenizer_source(tokenizer)

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda x: automaton(source).bpe.decode(bytes(x)) if x is not None else "")

    return df.withColumn("decoded", text(F.col(ids_col)))


def token_lengths(df: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``n_tokens`` of each row's whole text; a null text has none."""
    import pyarrow as pa

    source = tokenizer_source(tokenizer)

    def run(batches):
        at_work("tokens")
        ids = library(source)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in ids.texts(batch.column(0))], pa.int64())], ["n_tokens"])

    return small_batches(df).select(F.col(text_col).alias("text")).mapInArrow(run, "n_tokens long")


def length_histogram(df: DataFrame, tokenizer: str, text_col: str = "text", block: int = 1024) -> DataFrame:
    """One row per encoded length that occurs, with what suffix sums over the lengths say about a context limit of
    that length: ``n_tokens``, ``n_docs``; ``docs_at_least``, ``tokens_at_least`` (documents not shorter, their
    tokens); ``docs_at_most``; ``total_docs``, ``total_tokens``; ``truncated_total`` (tokens left if each document
    is cut to n_tokens). See truncated_total() and quantile() for limits and ranks that aren't a row.

    Counts are exact and cover every row. Documents are counted on the map side, so only (length, count) pairs move.
    Suffix sums take two levels, ``block`` lengths at a time, so no task holds the histogram. Null texts have
    length 0; an empty table gives no rows.
    """
    return suffix_sums(token_lengths(df, tokenizer, text_col).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), block)


def suffix_sums(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """Suffix sums over a histogram (n_tokens, n_docs) of distinct lengths."""
    from .common import durable

    tokens = (F.col("n_tokens") * F.col("n_docs")).alias("tokens")
    h = durable(histogram.select("n_tokens", "n_docs", tokens, F.floor(F.col("n_tokens") / block).alias("block")))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("toks"))
    # as many rows as blocks: the longest document's length over `block`
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("toks").over(later), F.lit(0)).alias("toks_later"),
        F.sum("docs").over(whole).alias("total_docs"),
        F.sum("toks").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = h.join(blocks, "block").select(
        "n_tokens", "n_docs", "total_docs", "total_tokens",
        (F.sum("n_docs").over(inside) + F.col("docs_later")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("toks_later")).alias("tokens_at_least"),
    )
    return out.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        "total_docs", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_total"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left if each document is cut to ``limit`` tokens, from the rows of suffix_sums(): the first
    length not below the limit says how many documents reach it."""
    above = F.min(F.when(F.col("n_tokens") >= limit, F.struct("n_tokens", "docs_at_least", "tokens_at_least")))
    total = F.coalesce(F.max("total_tokens"), F.lit(0))
    return sums.agg(F.lit(limit).cast("long").alias("limit"), (total - F.coalesce(above["tokens_at_least"], F.lit(0)) + F.coalesce(above["docs_at_least"], F.lit(0)) * limit).alias("truncated_total"))


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """One row: the least length that at least ``share`` of the documents don't exceed; null for an empty table."""
    return sums.agg(F.min(F.when(F.col("docs_at_most") >= F.col("total_docs") * F.lit(share), F.col("n_tokens"))).alias("n_tokens"))
