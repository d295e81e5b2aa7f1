"""Quality rules: base counts, and divergence from what is usual in a document's language.

References are counted over all documents of a language that pass the base rules: how often each class of characters
occurs, and each of its common words. A document's own histograms are compared with them by the Jensen-Shannon distance (base 2: 0 to 1).
Short documents have unreliable histograms, so a distance counts only above a minimum length.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import at_work, rows_of, small_batches

# Common words by language, one list each.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so dass kann nach wie bei sie aus um noch nur wir über einen oder am hat".split(),
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will no more if out".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le o este sí porque esta entre cuando muy sin sobre ser son también me hasta".split(),
    "fr": "de la le et les des en un une du que est dans qui par pour au sur il ne pas plus ce se son avec sont ou sa mais aux ont elle leur cette ces comme nous tout fait été on être".split(),
}
CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "other letter", "other")
SYMBOLS = "#*$%&|<>"
RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("js_classes", T.DoubleType()), T.StructField("js_words", T.DoubleType()), T.StructField("kept", T.BooleanType())]
)


@lru_cache(maxsize=1)
def _class_of():
    """Class of each code point, as a table over all of them."""
    import unicodedata

    import numpy as np

    table = np.full(0x110000, 7, np.uint8)
    letters = {"Ll": 0, "Lu": 1, "Lt": 1, "Lo": 6, "Lm": 6, "Nd": 2}
    for c in range(0x3000):
        kind = unicodedata.category(chr(c))
        table[c] = 3 if chr(c).isspace() else letters.get(kind, 5 if kind[0] == "S" or chr(c) in SYMBOLS else 4 if kind[0] == "P" else 7)
    table[0x3000:0x30000] = 6  # beyond, letters of scripts without case; few of the rest matter for a histogram
    table[0xE000:0xF900] = 7
    return table


def class_histogram(text: str):
    import numpy as np

    if text.isascii():
        return np.bincount(_class_of()[np.frombuffer(text.encode(), np.uint8)], minlength=8)
    return np.bincount(_class_of()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)], minlength=8)


@lru_cache(maxsize=64)
def _common(lang: str) -> tuple[bytes, ...]:
    return tuple(w.encode() for w in COMMON[lang])


def word_histogram(place: dict[bytes, int], counts, lang: str, n_words: int):
    """Counts of the language's common words, and of all others; place: word -> index into counts."""
    import numpy as np

    got = [int(counts[place[w]]) if w in place else 0 for w in _common(lang)]
    return np.array([*got, n_words - sum(got)], np.int64)


def js_distance(p, q) -> float:
    """Jensen-Shannon distance of two histograms; 0 if one of them is empty."""
    import numpy as np

    if p.sum() == 0 or q.sum() == 0:
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0.0).sum() + np.where(q > 0, q * np.log2(q / m), 0.0).sum()
    return float(np.sqrt(max(parts / 2, 0.0)))


def _places(words: list[bytes]):
    import numpy as np

    place: dict[bytes, int] = {}
    put = place.setdefault
    ids = np.fromiter([put(w, len(place)) for w in words], np.int64, len(words))
    return place, ids


def repeat_words(ids, n_distinct: int, window: int = 5) -> int:
    """Words in windows that are found twice or more."""
    import numpy as np

    n = len(ids)
    if n <= window:
        return 0
    codes, base = ids[: n - window + 1].copy(), max(n_distinct, 1)
    if base**window < 1 << 62:
        for k in range(1, window):
            codes = codes * base + ids[k : n - window + 1 + k]
    else:  # too many words for one number: rank after each step
        for k in range(1, window):
            codes = np.unique(codes * base + ids[k : n - window + 1 + k], return_inverse=True)[1].astype(np.int64)
    order = np.sort(codes)
    if not (order[1:] == order[:-1]).any():
        return 0
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    at = np.flatnonzero(np.isin(codes, twice))
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, np.minimum(at + window, n), -1)
    return int((np.cumsum(marks)[:n] > 0).sum())


def base_counts(text: str | None):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), and the words' places and counts."""
    import numpy as np

    if not text:
        return (0, 0, 0, 0, 0), {}, np.zeros(0, np.int64)
    data = text.encode("utf-8", "replace")
    words = data.split()  # for bytes: at space, tab, line feed, vertical tab, form feed and carriage return
    place, ids = _places(words)
    dup, lines = 0, data.split(b"\n")
    if len(lines) > 1:
        seen: set[bytes] = set()
        for line in lines:
            if line in seen:
                dup += bool(line.strip())
            else:
                seen.add(line)
    chars = len(text) - sum(map(data.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    return (len(words), chars, sum(data.count(c.encode()) for c in SYMBOLS), dup, repeat_words(ids, len(place))), place, np.bincount(ids, minlength=len(place))


def base_failed(counts: tuple) -> bool:
    """Whether base_counts()'s numbers fail a text: few words, or many in repeated windows."""
    return counts[0] < 10 or 100 * counts[4] > 20 * counts[0]


def references(df: DataFrame, lang_col: str = "lang", text_col: str = "text", languages: tuple[str, ...] = tuple(COMMON), least_reference: int = 10_000) -> dict:
    """(classes, words) histograms of each language over all its documents that pass the base rules: a few hundred
    numbers, as each task sums its own first. Languages that aren't listed have classes alone, from ``least_reference`` characters; null has none."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        total: dict[str, list] = {}

        def summed():
            rows = [(lang, kind, i, int(n)) for lang, both in total.items() for kind, h in enumerate(both) for i, n in enumerate(h)]
            total.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "kind", "i", "n"])

        at_work("quality")
        for batch in batches:
            for lang, text in rows_of(batch):
                counts, place, hist = base_counts(text)
                if base_failed(counts):
                    continue
                got = [class_histogram(text)]
                if lang in languages:
                    got.append(word_histogram(place, hist, lang, counts[0]))
                total[lang] = [a + b for a, b in zip(total[lang], got, strict=True)] if lang in total else got
                if len(total) >= 4096:  # not languages, but whatever a column may hold
                    yield from summed()
        yield from summed()

    counted = small_batches(df).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull()).mapInArrow(run, "lang string, kind long, i long, n long")
    summed = counted.groupBy("lang", "kind").agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col("i") == i, F.col("n"))).alias(f"n{i}") for i in range(max([len(CLASSES), *[len(COMMON[x]) + 1 for x in languages]]))])
    out: dict = {lang: (np.zeros(len(CLASSES), np.int64), np.zeros(len(COMMON[lang]) + 1, np.int64)) for lang in languages}
    for r in summed.where(F.col("lang").isin(*languages) | (F.col("all") >= least_reference)).collect():
        if r.lang not in out:
            out[r.lang] = (np.zeros(len(CLASSES), np.int64), None)
        h = out[r.lang][r.kind]
        h[:] = [r[f"n{i}"] or 0 for i in range(len(h))]
    return out


def assess(df: DataFrame, refs: dict | None = None, lang_col: str = "lang", text_col: str = "text", most_classes: tuple[float, float] = (0.12, 2.6), most_words: tuple[float, float] = (0.14, 1.5), least_chars: int = 200, least_words: int = 50):
    """A column: struct of the base counts, ``base_failed``, the distances (null where the document is too short or
    its language has no reference, or no list of common words) and ``kept``.

    A distance may be a + b / sqrt(n) at most, with n characters or words: the less text, the further chance alone
    takes a histogram from its reference. A null or empty text has no words and fails the base rules. A null language leaves only these,
    an unlisted one these and the classes of characters.
    """
    refs = references(df, lang_col, text_col) if refs is None else refs
    small_batches(df)

    @F.arrow_udf(RESULT)
    def judge(lang, text):
        import pyarrow as pa

        at_work("quality")
        cols: list[list] = [[] for _ in range(9)]
        for code, t in rows_of(pa.RecordBatch.from_arrays([lang, text], ["lang", "text"])):
            counts, place, hist = base_counts(t)
            n = counts[0]
            failed = base_failed(counts)
            dc = dw = None
            if code in refs and t:
                if len(t) >= least_chars:
                    dc = js_distance(class_histogram(t), refs[code][0])
                if n >= least_words and refs[code][1] is not None:
                    dw = js_distance(word_histogram(place, hist, code, n), refs[code][1])
            kept = not failed and (dc is None or dc <= most_classes[0] + most_classes[1] / len(t) ** 0.5) and (dw is None or dw <= most_words[0] + most_words[1] / n**0.5)
            for c, v in zip(cols, (*counts, failed, dc, dw, kept), strict=True):
                c.append(v)
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_classes", "js_words", "kept"]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return judge(F.col(lang_col), F.col(text_col))


def quality_rules(df: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", **limits) -> DataFrame:
    """One row per input row: ``id`` and the fields of assess(). Null or repeated ids are passed through; other
    columns are ignored; an empty table gives no rows."""
    return df.select(F.col(id_col).alias("id"), assess(df, None, lang_col, text_col, **limits).alias("q")).select("id", "q.*")


def keep_good(df: DataFrame, lang_col: str = "lang", text_col: str = "text", **limits) -> DataFrame:
    """The rows that the rules keep, with the columns of ``df``."""
    q = assess(df, None, lang_col, text_col, **limits)
    return df.where(q["kept"])
