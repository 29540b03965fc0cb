"""Merkle manifest of a table of documents: digests, proofs and their check.

Every document is a leaf, the digest of its fields. Per language, ``FANOUT`` consecutive
nodes in the order of ids become the digest of their digests, level by level, until one is
left: the subroot of the language; the subroots, in the order of languages, become the
root in the same way.

Content-addressed descent. What is stored is one record per distinct node, its digest and
its children's digests. Proofs come from the records alone: the requests descend from the
root, and where they stand is told by the digits of their rank. At every height the
digests reached are joined with the records; the children whose digits a request has are
entered, and what is left and right of them is added to the path. Requests with the same
digits so far travel as one row, so a height takes as many rows as it has nodes, and only
the last digit is looked up per document. The path from the root is read backwards as the
proof.

Ranks come from one written range layout (no order in one task); a group of any size is
spread over all tasks, since its nodes are grouped by eights.

Defined cases: null fields are written as ``-``; the empty text is a value; null is a
language of its own, before all others; rows with one id follow each other in the order of
their digests, null ids first; repeated rows are leaves of their own; a language with one
document has that leaf as its subroot and no siblings there, and a table with one language
has its subroot as its root; an empty table has no rows; extra columns are not carried.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalkit.llm.common import materialize, small_enough
from evalkit.plans.ordering import global_index
from evalkit.session import scratch_path

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Salts of the join on the language when the table of languages is too large to broadcast.
SALTS = 64
STEP = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of the fields one after the other, each with its length in bytes."""
    def written(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return digest(F.concat(*map(written, fields)))


def height(n: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def leaves(docs: DataFrame, tampered: Column | None = None, altered: Column | None = None) -> DataFrame:
    """doc_id, lang, leaf, presented (the leaf of the row as it is presented for checking: with
    ``altered`` as its text where ``tampered`` holds), group (index of the language) and rank
    in the group, and size of the group."""
    fields = [F.col(f) for f in FIELDS]
    own = leaf_digest(fields)
    other = own if tampered is None else F.when(tampered, leaf_digest([*fields[:-1], altered])).otherwise(F.lit(None))
    rows = docs.select(F.col("doc_id"), F.col("lang"), own.alias("leaf"), other.alias("presented"))
    placed = global_index(rows, [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf"], "_llm_at")
    groups = placed.groupBy("lang").agg(F.min("_llm_at").alias("_llm_first"), F.count(F.lit(1)).alias("size"))
    groups = global_index(groups, [F.col("lang").asc_nulls_first()], "group")
    groups = materialize(groups.select(F.col("lang").alias("_llm_lang"), "_llm_first", "size", "group"), "merkle-groups")
    on = F.col("lang").eqNullSafe(F.col("_llm_lang"))
    if small_enough(groups, F.coalesce(F.octet_length("_llm_lang"), F.lit(0)) + 64):
        joined = placed.join(F.broadcast(groups), on)
    else:
        placed = placed.withColumn("_llm_salt", F.col("_llm_at") % SALTS)
        spread = groups.withColumn("_llm_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = placed.join(spread, on & (F.col("_llm_salt") == F.col("_llm_s")))
    return joined.select("doc_id", "lang", "leaf", F.coalesce("presented", "leaf").alias("presented"),
                         F.col("group").cast("long").alias("group"), (F.col("_llm_at") - F.col("_llm_first")).alias("rank"),
                         F.col("size").cast("long").alias("size"))


class Manifest:
    """The records of a tree, in a folder: ``lang`` and ``top`` hold a table per height."""

    def __init__(self, spark: SparkSession, folder: str, top: int, lang: int, root: str):
        self.spark, self.folder, self.root = spark, folder, root
        self.heights = {"top": top, "lang": lang}

    def records(self, tree: str, level: int) -> DataFrame:
        """(digest, children), one row per distinct node of a height."""
        path = f"{self.folder}/{tree}-{level}"
        return self.spark.read.schema("digest string, children array<string>").parquet(path)


def _grow(nodes: DataFrame, levels: int, folder: str, tree: str) -> DataFrame:
    """Write the records of every height over ``nodes`` (group, rank, size, digest) and return
    the last node of every group, with the height it has."""
    spark, finished = nodes.sparkSession, []
    for level in range(levels + 1):
        finished.append(nodes.filter("size = 1").select("group", "digest", F.lit(level).alias("height")))
        if level == levels:
            break
        run = F.array_sort(F.collect_list(F.struct("rank", "digest")))
        up = (nodes.filter("size > 1").groupBy("group", F.expr(f"rank div {FANOUT}").alias("rank"))
              .agg(F.first("size").alias("size"), F.transform(run, lambda x: x["digest"]).alias("children"))
              .select("group", "rank", F.expr(f"(size + {FANOUT - 1}) div {FANOUT}").alias("size"), "children"))
        up = materialize(up.withColumn("digest", digest(F.array_join("children", ""))), "merkle-level")
        up.select("digest", "children").dropDuplicates(["digest"]).write.parquet(f"{folder}/{tree}-{level + 1}")
        nodes = up.drop("children")
    return functools.reduce(DataFrame.unionByName, finished)


def manifest(placed: DataFrame) -> tuple[Manifest | None, DataFrame | None]:
    """The manifest over ``leaves`` (a written table), and (group, digest, height, top rank) of
    the subroots; (None, None) for an empty table."""
    spark = placed.sparkSession
    largest = placed.agg(F.max("size").alias("n"), F.max("group").alias("g")).first()
    if largest["n"] is None:
        return None, None
    folder = scratch_path(spark, "merkle-records")
    lang, top = height(largest["n"]), height(largest["g"] + 1)
    subroots = _grow(placed.select("group", "rank", "size", F.col("leaf").alias("digest")), lang, folder, "lang")
    subroots = materialize(subroots, "merkle-subroots")
    nodes = subroots.select(F.lit(0).cast("long").alias("group"), F.col("group").alias("rank"),
                            F.lit(largest["g"] + 1).cast("long").alias("size"), "digest")
    root = _grow(nodes, top, folder, "top").first()["digest"]
    return Manifest(spark, folder, top, lang, root), subroots


def _split(children: Column, digit: Column) -> Column:
    """What is left and right of a child."""
    n = F.size(children)
    return F.struct(F.array_join(F.slice(children, F.lit(1), digit), "").alias("left"),
                    F.array_join(F.slice(children, digit + 2, n), "").alias("right"))


def _enter(at: DataFrame, records: DataFrame) -> DataFrame:
    """One height down: every child of the nodes reached, its path longer by its siblings."""
    met = at.join(records, "digest")
    child = met.select("*", F.posexplode("children").alias("digit", "child"))
    return child.select(*[c for c in at.columns if c not in ("rank", "digest", "path")],
                        (F.col("rank") * FANOUT + F.col("digit")).alias("rank"), F.col("child").alias("digest"),
                        F.concat("path", F.array(_split(F.col("children"), F.col("digit")))).alias("path"))


def proofs(found: Manifest, subroots: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (columns of ``leaves``) with subroot, root and path: from the root to the
    leaf, the siblings left and right at every level. ``subroots`` tells the height at which a
    language stands below the root; it may hold requested languages only."""
    spark = requests.sparkSession
    at = spark.range(1).select(F.lit(0).cast("long").alias("rank"), F.lit(found.root).alias("digest"),
                               F.array().cast(STEP).alias("path"))
    for level in range(found.heights["top"], 0, -1):
        at = _enter(at, found.records("top", level))
    # the digits of the language are used up: its own descent starts at its height
    entered = (at.withColumnRenamed("rank", "group").join(subroots.select("group", "height"), "group")
               .select("group", F.lit(0).cast("long").alias("rank"), "digest", "path", F.col("digest").alias("subroot"), "height"))
    entered = materialize(entered, "merkle-entered")
    at = None
    for level in range(found.heights["lang"], 1, -1):
        own = entered.filter(F.col("height") == level).drop("height")
        at = _enter(own if at is None else at.unionByName(own), found.records("lang", level))
    last = entered.filter("height = 1").drop("height")
    last = last if at is None else at.unionByName(last)
    if found.heights["lang"]:
        last = last.join(found.records("lang", 1), "digest")
    else:
        last = last.withColumn("children", F.lit(None).cast("array<string>"))
    alone = (entered.filter("height = 0").drop("height")
             .withColumn("children", F.lit(None).cast("array<string>")))
    last = last.unionByName(alone).select(F.col("group").alias("_g"), F.col("rank").alias("_r"), "path", "subroot", "children")
    asked = requests.withColumn("_n", F.expr(f"rank div {FANOUT}"))
    met = asked.join(last, (F.col("group") == F.col("_g")) & (F.col("_n") == F.col("_r")))
    step = F.array(_split(F.col("children"), (F.col("rank") % FANOUT).cast("int")))
    path = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat("path", step))
    return met.select(*requests.columns, "subroot", F.lit(found.root).alias("root"), path.alias("path"))


def siblings(path: Column) -> Column:
    """The digests of a proof, from the leaf's level to the root's, as one text."""
    return F.array_join(F.transform(F.reverse(path), lambda s: F.concat(s["left"], s["right"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(F.reverse(path), leaf, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def audit(docs: DataFrame, tampered: Column, altered: Column) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, path, proof_sha256, and whether the row as it
    is presented (``altered`` text where ``tampered`` holds) still folds to the root."""
    placed = materialize(leaves(docs, tampered, altered), "merkle-leaves")
    found, subroots = manifest(placed)
    if found is None:
        placed = placed.withColumns({"subroot": F.col("leaf"), "root": F.col("leaf"), "path": F.array().cast(STEP)})
        proved = placed
    else:
        proved = proofs(found, subroots, placed)
    folded = proved.select("doc_id", "leaf", "subroot", "root", "path", digest(siblings(F.col("path"))).alias("proof_sha256"),
                           fold(F.col("presented"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered(text: Column) -> Column:
    """The letters A to Z of a text in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)
