"""Directory trees derived from paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def ancestors(entries: DataFrame) -> DataFrame:
    """Every directory that the entries' paths imply: ``path`` (with its final slash), ``parent`` (null for the
    root), ``name``, ``depth``. Distinct directories are found before they are spread out into their parents."""
    dirs = entries.select("dir_path").distinct()
    parts = F.filter(F.split("dir_path", "/"), lambda x: x != "")
    spread = dirs.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.lit("/"), F.when(n > 0, F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))).otherwise("")))).alias("path")).distinct()
    return spread.select("path", F.when(F.col("path") != "/", T.parent_of(F.col("path"))).alias("parent"), T.file_name(F.col("path")).alias("name"), T.depth_of(F.col("path")).alias("depth"))


def paths_from_nodes(spark: SparkSession, dirs: DataFrame, levels: int = 1000) -> DataFrame:
    """Paths of parent-pointer nodes (id, parent, name), by a recursive query: ``id``, ``path``, ``depth``. Nodes
    that no root reaches are left out."""
    return spark.sql(
        f"WITH RECURSIVE tree(id, path, depth) MAX RECURSION LEVEL {levels} AS ("
        "SELECT id, CASE WHEN name = '' THEN '/' ELSE concat('/', name, '/') END, CASE WHEN name = '' THEN 0 ELSE 1 END FROM {nodes} WHERE parent IS NULL "
        "UNION ALL SELECT d.id, concat(t.path, d.name, '/'), t.depth + 1 FROM tree t JOIN {nodes} d ON d.parent = t.id) SELECT id, path, depth FROM tree",
        nodes=dirs,
    )


def subtree(entries: DataFrame, root: str) -> DataFrame:
    """The entries below a directory."""
    return entries.where(F.startswith("dir_path", F.lit(root.rstrip("/") + "/")))


def listing(dirs: DataFrame, excluded: list[str]) -> DataFrame:
    """Directories in pre-order without the subtrees of excluded names; ``dirs`` as ancestors() gives them."""
    return dirs.where(T.watchable(F.trim(F.col("path"), F.lit("/")), excluded)).orderBy("path")


def frontier(paths: list[tuple[str, int]], budget: int, most: int = 512, roots: tuple[str, ...] = ("/",)) -> tuple[list[str], list[str]]:
    """(watched, roots of what isn't watched) when ``budget`` directories of a pre-order listing can be watched.
    More than ``most`` unwatched subtrees are given as the roots as a whole."""
    watched, left = [], []
    for path, _ in paths:
        if left and path.startswith(left[-1]):
            continue
        if len(watched) < budget:
            watched.append(path)
        else:
            left.append(path)
    return watched, left if len(left) <= most else list(roots)


def unwatched(dirs: DataFrame, budget: int, most: int = 512, roots: tuple[str, ...] = ("/",)) -> list[str]:
    """Roots of the subtrees beyond a budget of directories in pre-order; what frontier() gives, without the listing on
    the driver. ``dirs``: (path with its final slash, parent). More than ``most`` such subtrees are the roots as a whole."""
    first = dirs.select("path").orderBy("path").offset(budget).limit(1).first()
    if first is None:
        return []
    beyond = dirs.where((F.col("path") >= first.path) & (F.col("parent").isNull() | (F.col("parent") < first.path)))
    left = [r.path for r in beyond.select("path").orderBy("path").limit(most + 1).collect()]
    return left if len(left) <= most else list(roots)
