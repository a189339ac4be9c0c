"""Merkle manifest of a dataset, with proofs by pointer jumping.

Rows are leaves; every 16 consecutive nodes of a tree (one tree for each source) become a node, up to the subroot, and the
subroots likewise up to the root. A run of siblings is one row of a table, under its parent. Every node points to an
ancestor, at first its parent, and holds the segment of siblings on the way there. A round joins the table with itself:
the ancestor's segment is put behind the node's, the ancestor's ancestor takes its place, and the distance doubles, until all
point to the root. The leaves of a run share all that lies above their parent, so they travel in the parent's row; their
own siblings are in that row too.

Rows are ordered by a range shuffle on source, doc_id and digest, so that a source of any size lies in many tasks; a row's
number is its place in its task plus the rows of its source in the tasks before. In round r at most n / 16^(2^r) nodes are
somebody's ancestor, and none has more than 16^(2^r) rows that point to it: either the ancestors are few enough to be
broadcast (their size is checked), or no key of the shuffled join is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonegrain.llm import common

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A table of up to this many bytes is broadcast; beyond it a shuffled join does the same.
BROADCAST_BYTES = 16 << 20
#: The tree of subroots; those of sources are numbered from 0.
TOP = -1

_PATH = "array<struct<left: string, right: string>>"
_NODE = ["tree", "level", "idx"]


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field is "-" if null, else its length in bytes, ":" and its value."""
    said = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*said), 256)


def folded(proof: Column, digest: Column) -> Column:
    """The root that a leaf and a proof (an array of left and right siblings, from the leaf up) lead to."""
    return F.aggregate(proof, digest, lambda x, step: F.sha2(F.concat(step["left"], x, step["right"]), 256))


def _small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (source, doc_id, leaf, ...) with tree (the source's number), at (the row's number in its source) and total (rows of the source)."""
    keys = ["source", "doc_id", "leaf", "tie"]
    spread = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    placed = common.saved(spread.withColumn("place", F.monotonically_increasing_id()), "leaves").withColumn("task", F.shiftright("place", 33))
    spans, n = common.counted(placed.groupBy("task", "source").agg(F.min("place").alias("first"), F.count("*").alias("n")), "spans", F.count("*").alias("rows"))
    sources = spans.groupBy("source").agg(F.min("task").alias("home"), F.sum("n").alias("total"))
    # One number a task: sources that begin in it.
    begun = sorted((r[0], r[1]) for r in sources.groupBy("home").count().collect())
    offsets = [(h, sum(c for _, c in begun[:i])) for i, (h, _) in enumerate(begun)]
    base = rows.sparkSession.createDataFrame(offsets, "home long, begin long")
    nth = F.row_number().over(Window.partitionBy("home").orderBy("source"))
    numbers = sources.join(F.broadcast(base), "home").select(F.col("source").alias("name"), (F.col("begin") + nth - 1).alias("tree"), "total")
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = spans.withColumn("earlier", earlier).join(_small(numbers, n["rows"], 200), F.col("source").eqNullSafe(F.col("name"))).select(F.col("task").alias("t"), F.col("source").alias("s"), "first", "earlier", "tree", "total")
    return placed.join(_small(offset, n["rows"], 200), (F.col("task") == F.col("t")) & F.col("source").eqNullSafe(F.col("s"))).withColumn("at", F.col("place") - F.col("first") + F.col("earlier"))


def _siblings(members: str, place: str) -> Column:
    return F.expr(f"struct(array_join(slice({members}, 1, {place}), '') as left, array_join(slice({members}, {place} + 2, size({members})), '') as right)")


def _climb(nodes: DataFrame, level: int, fanout: int) -> tuple[DataFrame, list[DataFrame]]:
    """The last node of each tree of nodes (grp, tree, level, idx, at, digest, total), and a row for each other one: its parent and its siblings."""
    steps, tops = [], []
    while True:
        tops.append(nodes.where("total = 1"))
        most = nodes.agg(F.max("total")).first()[0]
        if (most or 0) <= 1:
            break
        run = F.expr(f"at div {fanout}").alias("run")
        runs = nodes.where("total > 1").groupBy("grp", "total", run).agg(F.array_sort(F.collect_list(F.struct("at", "digest", *_NODE))).alias("m"))
        runs = common.saved(runs.withColumn("digests", F.col("m.digest")), "runs", tasks=max(8, -(-most // 100_000)))
        one = runs.select("grp", "run", "digests", F.posexplode("m").alias("p", "c"))
        steps.append(one.select("c.tree", "c.level", "c.idx", F.col("grp").alias("up_tree"), F.lit(level).alias("up_level"), F.col("run").alias("up_idx"), F.array(_siblings("digests", "p")).cast(_PATH).alias("path")))
        nodes = runs.select("grp", F.col("grp").alias("tree"), F.lit(level).alias("level"), F.col("run").alias("idx"), F.col("run").alias("at"), F.sha2(F.array_join("digests", ""), 256).alias("digest"), F.expr(f"(total + {fanout - 1}) div {fanout}").alias("total"))
        level += 1
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out, steps


def _jumped(steps: DataFrame) -> DataFrame:
    """steps with every node's path to the root."""
    ups = ["up_tree", "up_level", "up_idx"]
    steps, n = common.counted(steps, "pointers", F.count("*").alias("rows"), F.max("level").alias("level"))
    reach, moved = 1, n["rows"]
    while moved:
        # Only these can be an ancestor at this distance.
        far = steps.where((F.col("tree") == TOP) | (F.col("level") > reach)).select(*(F.col(c).alias(u) for c, u in zip(_NODE, ups, strict=True)), *(F.col(u).alias(f"next_{u}") for u in ups), F.col("path").alias("beyond"))
        few = far.count()
        if not few:
            break
        jumped = steps.join(_small(far, few, 80 + reach * FANOUT * 64), ups, "left")
        to = [F.coalesce(f"next_{u}", u).alias(u) for u in ups]
        tasks = max(8, -(-n["rows"] // 20_000))
        steps, found = common.counted(jumped.select(*_NODE, *to, F.when(F.col("beyond").isNull(), F.col("path")).otherwise(F.concat("path", "beyond")).alias("path"), F.col("beyond").isNotNull().alias("moved")), "pointers", F.count_if("moved").alias("rows"), tasks=tasks)
        steps, moved, reach = steps.drop("moved"), found["rows"], 2 * reach
    return steps


def manifest(docs: DataFrame, also: Column | None = None, fields: tuple[str, ...] = FIELDS, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, also for each row of docs (doc_id, source and the other fields).

    proof has the siblings (left, right; digests end to end) of the leaf and of each ancestor below the root. also: a column
    over docs, carried along (such as the digest of another version of the row).
    Null fields have a digest of their own, a null source is a source (the first), and rows without doc_id come first in
    theirs. Rows that repeat a doc_id are leaves in the order of their digests. A single leaf is its subroot, a single subroot
    the root. An empty table gives no row. Columns that aren't fields aren't read.
    """
    spark = docs.sparkSession
    also = (F.lit(None) if also is None else also).cast("string")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), leaf([docs[f] for f in fields]).alias("leaf"), also.alias("also"))
    leaves = _numbered(rows).select("tree", "total", F.expr(f"at div {fanout}").alias("idx"), F.struct("at", "leaf", "doc_id", "also").alias("m"))
    runs = leaves.groupBy("tree", "total", "idx").agg(F.array_sort(F.collect_list("m")).alias("m"))
    digests = F.col("m.leaf")
    runs = runs.withColumns({"digests": digests, "digest": F.when(F.col("total") > 1, F.sha2(F.array_join(digests, ""), 256)).otherwise(digests[0]), "level": F.when(F.col("total") > 1, 1).otherwise(0)})
    runs = common.saved(runs, "leaf-runs")
    nodes = runs.select(F.col("tree").alias("grp"), *_NODE, F.col("idx").alias("at"), "digest", F.expr(f"(total + {fanout - 1}) div {fanout}").alias("total"))
    subroots, steps = _climb(nodes, 2, fanout)
    subroots, n = common.counted(subroots, "subroots", F.count("*").alias("rows"))
    top, more = _climb(subroots.select(F.lit(TOP).cast("long").alias("grp"), *_NODE, F.col("tree").alias("at"), "digest", F.lit(n["rows"]).cast("long").alias("total")), 1, fanout)
    root = top.select("digest").first()
    runs = runs.join(_small(subroots.select("tree", F.col("digest").alias("subroot")), n["rows"], 100), "tree")
    steps += more
    if steps:
        pointers = steps[0]
        for s in steps[1:]:
            pointers = pointers.unionByName(s)
        above = _jumped(pointers).where("level <= 1").select(*_NODE, "path")
        runs = runs.join(above, _NODE, "left")
    else:
        runs = runs.withColumn("path", F.lit(None).cast(_PATH))
    one = runs.select("subroot", "path", "total", "digests", F.posexplode("m").alias("p", "c"))
    own = F.when(F.col("total") > 1, F.array(_siblings("digests", "p")).cast(_PATH)).otherwise(F.array().cast(_PATH))
    proof = F.concat(own, F.coalesce("path", F.array().cast(_PATH)))
    return one.select("c.doc_id", "c.leaf", "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), proof.alias("proof"), "c.also")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(common.remainder("doc_id", 5) == 0, leaf([lower if f == "text" else F.col(f) for f in FIELDS]))
    found = manifest(docs, tampered)
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    again = folded(F.col("proof"), F.coalesce("also", "leaf"))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = """
WITH RECURSIVE b AS (SELECT byte, (SELECT list_reduce(list_prepend(byte, range(0, 8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS e FROM range(0, 256) t(byte)),
tab AS (SELECT list(e ORDER BY byte) AS t FROM b),
d AS (SELECT doc_id, source, lang, n_chars, text, row_number() OVER () AS rid, xor(4294967295, (SELECT list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)), lambda c, ch: xor(c >> 8, t[xor(c & 255, ch) + 1])) FROM tab)) AS h FROM documents),
f AS (SELECT *, concat_ws('', CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END, CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head FROM d),
x AS MATERIALIZED (SELECT rid, doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf, CASE WHEN h % 5 = 0 THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) END AS bad FROM f),
n AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS sno, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS total FROM x),
up(tree, level, i, digest, total) AS (SELECT sno, 0, i, leaf, total FROM n UNION ALL SELECT tree, level + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)), (total + 15) // 16 FROM up WHERE total > 1 GROUP BY tree, level, i // 16, total),
s AS MATERIALIZED (SELECT tree AS sno, level AS depth, digest AS subroot FROM up WHERE total = 1),
top(level, i, digest, total) AS (SELECT 0, sno, subroot, (SELECT count(*) FROM s) FROM s UNION ALL SELECT level + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)), (total + 15) // 16 FROM top WHERE total > 1 GROUP BY level, i // 16, total),
a AS MATERIALIZED (SELECT tree, level, i // 16 AS run, list(digest ORDER BY i) AS m FROM up WHERE total > 1 GROUP BY ALL UNION ALL SELECT -1, level, i // 16, list(digest ORDER BY i) FROM top WHERE total > 1 GROUP BY ALL),
p(rid, tree, level, i, depth, sno, proof, folded) AS (SELECT rid, sno, 0, i, depth, sno, '', coalesce(bad, leaf) FROM n JOIN s USING (sno)
 UNION ALL SELECT p.rid, CASE WHEN p.tree >= 0 AND p.level + 1 >= p.depth THEN -1 ELSE p.tree END, CASE WHEN p.tree >= 0 AND p.level + 1 >= p.depth THEN 0 ELSE p.level + 1 END, CASE WHEN p.tree >= 0 AND p.level + 1 >= p.depth THEN p.sno ELSE p.i // 16 END, p.depth, p.sno,
  CASE WHEN p.tree >= 0 AND p.depth = 0 THEN p.proof ELSE p.proof || array_to_string(a.m[1:p.i % 16], '') || array_to_string(a.m[p.i % 16 + 2:], '') END,
  CASE WHEN p.tree >= 0 AND p.depth = 0 THEN p.folded ELSE sha256(array_to_string(a.m[1:p.i % 16], '') || p.folded || array_to_string(a.m[p.i % 16 + 2:], '')) END
 FROM p LEFT JOIN a ON a.tree = p.tree AND a.level = p.level AND a.run = p.i // 16 WHERE (p.tree >= 0 AND p.depth = 0) OR a.m IS NOT NULL),
z AS (SELECT rid, proof, folded FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY (tree = -1)::INT DESC, level DESC) AS k FROM p) WHERE k = 1),
r AS (SELECT digest AS root FROM top WHERE total = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM n JOIN s USING (sno) JOIN z USING (rid), r
"""
