"""A Merkle manifest of a dataset: leaves, a tree for each language, a tree over their roots, and inclusion proofs.

Leaves are numbered by a range-partitioned sort and stay where the sort has put them. Each task takes its nodes as events:
a parent is held, by tree, level and index, until as many children have come as the tree's size says it has; then it is
hashed and is itself an event of the next level. What a task cannot complete is its frontier: fewer than fifteen nodes a
level and tree. Frontiers are dealt anew by their ancestor REACH levels up, climb again, and so on to the roots. Every
parent keeps its children's digests: these reverse links, handed down by block of leaves, are the proofs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .common import SLICE_ROWS, Narrow, discard, staged, table

#: Children of a parent, and the bits of an index that tell them apart.
ARITY, BITS = 8, 3
#: Levels that a frontier climbs between two shuffles, and those of a block of leaves whose proofs one task makes.
REACH = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree binary, n bigint, level int, idx bigint, digest string, run string, open boolean"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def width(n: int, level: int) -> int:
    """Nodes on a level of a tree of n leaves; one on its top level."""
    return -(-n >> BITS * level)


def framed(c: Column) -> Column:
    """A value as its length in UTF-8 bytes, a colon and itself; null as a dash."""
    c = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf_of(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(framed, columns)).cast("binary"), 256)


def climb(events: Iterable[tuple[bytes, int, int, int, str]]) -> Iterator[tuple]:
    """Rows of _NODE from events (tree, n, level, idx, digest), which may come in any order.

    A completed parent has the digests of its children, joined, as run; a tree's top node comes once more with an empty
    run; what waits for children of other tasks comes last, open.
    """
    waiting: dict[tuple[bytes, int, int], tuple[int, dict[int, str]]] = {}
    for tree, n, level, idx, own in events:
        while True:
            wide = width(n, level)
            if wide == 1:
                yield tree, n, level, idx, own, "", False
                break
            first = idx >> BITS << BITS
            key = tree, level, first
            held = waiting.setdefault(key, (n, {}))[1]
            held[idx] = own
            if len(held) < min(ARITY, wide - first):
                break
            del waiting[key]
            run = "".join(held[k] for k in sorted(held))
            level, idx, own = level + 1, idx >> BITS, digest(run)
            yield tree, n, level, idx, own, run, False
    for (tree, level, _), (n, held) in waiting.items():
        for idx, own in held.items():
            yield tree, n, level, idx, own, None, True


def _sliced(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == SLICE_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns], strict=True)


def _mapped(df: DataFrame, work, schema: StructType | str) -> DataFrame:
    """work on the rows of each task, as tuples, one batch of them at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda batches: _sliced(work(_rows(batches)), arrow), schema)


def numbered(leaves: DataFrame) -> DataFrame:
    """leaves (tree, key, leaf, ...) with idx, the place in the tree by key (null first) and leaf, and n, the tree's size.

    Equal rows are told apart by their place in the staged input, so that many of them do not meet in one task.
    """
    given = staged(leaves, "leaves")
    order = [F.col("tree"), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("row")]
    placed = given.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select(*given.columns, F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("rank"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ranks = []
            for now in batch.column(0).to_pylist():
                tree, at = now, at + 1 if now == tree else 0
                ranks.append(at)
            kept = [batch.column(k) for k in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([part] * len(ranks), pa.int32()), pa.array(ranks, pa.int64())], names=batch.schema.names)

    placed = staged(placed.select("tree", *[c for c in placed.columns if c != "tree"]).mapInArrow(rank, placed.select("tree", *[c for c in placed.columns if c != "tree"]).schema), "placed")
    discard(given)
    pieces = staged(placed.groupBy("part", "tree").agg(F.count("*").alias("rows")), "pieces")
    before = F.sum("rows").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = pieces.groupBy("tree").agg(F.sum("rows").alias("n"))
    pieces = staged(pieces.withColumn("before", F.coalesce(before, F.lit(0))).join(sizes, "tree").select("part", "tree", "before", "n"), "offsets")
    return placed.join(pieces, ["part", "tree"]).withColumn("idx", F.col("before") + F.col("rank")).drop("part", "rank", "before")


def grown(leaves: DataFrame) -> DataFrame:
    """All nodes above numbered leaves (tree, idx, n, leaf), as closed rows of _NODE, and the top ones with an empty run."""
    nodes = staged(_mapped(leaves.select("tree", "n", F.lit(0).alias("level"), "idx", "leaf"), climb, _NODE), "nodes")
    done = nodes.where(~F.col("open"))
    height = 0
    while not (frontier := nodes.where("open")).isEmpty():
        height += REACH
        meet = F.greatest(F.lit(height), F.col("level") + 1)
        dealt = frontier.select("tree", "n", "level", "idx", "digest").withColumns({"meet": meet, "under": F.expr(f"shiftright(idx, int({BITS} * (greatest({height}, level + 1) - level)))")})
        dealt = dealt.repartition(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tree", "meet", "under").drop("meet", "under")
        nodes = staged(_mapped(dealt, climb, _NODE), "nodes")
        done = done.unionByName(nodes.where(~F.col("open")))
    return done


def _above(nodes: DataFrame) -> DataFrame:
    """(tree, idx, above): of every node on level REACH, the runs of its ancestors from its parent's on."""
    parents = nodes.where(f"run <> '' and level > {REACH}")
    top = parents.agg(F.max("level")).first()[0] or REACH
    empty = F.array().cast("array<string>")
    known = None  # (tree, idx, above) of the level in hand
    for level in range(top, REACH - 1, -1):
        here = nodes.where((F.col("level") == level) & (F.col("run") != "")).select("tree", "idx")
        if known is None:
            known = here.withColumn("above", empty)
            continue
        up = parents.where(F.col("level") == level + 1).select("tree", "idx", "run").join(known, ["tree", "idx"]).select("tree", F.col("idx").alias("up"), F.concat(F.array("run"), F.col("above")).alias("more"))
        known = here.withColumn("up", F.shiftright("idx", BITS)).join(up, ["tree", "up"], "left").select("tree", "idx", F.coalesce("more", empty).alias("above"))
    return known


def _proofs(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (columns of the leaf, then proof) from the rows of whole blocks: first what lies above, then runs, then leaves."""
    above: list[str] = []
    runs: dict[tuple[int, int], str] = {}
    block = None
    for tree, at, kind, level, idx, given, *rest in rows:
        if (tree, at) != block:
            block, above, runs = (tree, at), [], {}
        if kind == 0:
            above = given
        elif kind == 1:
            runs[level, idx] = given[0]
        else:
            steps = []
            lower = [run for up in range(1, REACH + 1) if (run := runs.get((up, idx >> BITS * up)))]
            for up, run in enumerate([*lower, *above]):
                cut = 64 * (idx >> BITS * up & ARITY - 1)
                steps.append({"left": run[:cut], "right": run[cut + 64 :]})
            yield (tree, idx, *rest, steps)


PROOF = ArrayType(StructType([StructField("left", StringType()), StructField("right", StringType())]))


def proven(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """Numbered leaves (tree, idx, n, leaf, ...) with proof: from the leaf up, what stands left and right of it in its run.

    Blocks of ARITY ** REACH leaves meet the reverse links below and above their common ancestor; no leaf is joined level
    by level.
    """
    rest = [c for c in leaves.columns if c not in ("tree", "idx", "n")]
    under = lambda: F.expr(f"shiftright(idx, int({BITS} * ({REACH} - level)))")
    blank = [F.lit(None).cast(leaves.schema[c].dataType).alias(c) for c in rest]
    runs = nodes.where(f"run <> '' and level <= {REACH}").select("tree", under().alias("block"), F.lit(1).alias("kind"), "level", "idx", F.array("run").alias("given"), *blank)
    above = _above(nodes).select("tree", F.col("idx").alias("block"), F.lit(0).alias("kind"), F.lit(REACH).alias("level"), "idx", F.col("above").alias("given"), *blank)
    own = leaves.select("tree", F.shiftright("idx", BITS * REACH).alias("block"), F.lit(2).alias("kind"), F.lit(0).alias("level"), "idx", F.lit(None).cast("array<string>").alias("given"), *rest)
    dealt = own.unionByName(runs).unionByName(above).repartition(int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tree", "block").sortWithinPartitions("tree", "block", "kind")
    return _mapped(dealt, _proofs, StructType([leaves.schema["tree"], leaves.schema["idx"], *[leaves.schema[c] for c in rest], StructField("proof", PROOF)]))


def folded(leaf: Column, proof: Column) -> Column:
    """The root to which a leaf and its proof lead."""
    return F.aggregate(proof, leaf, lambda own, p: F.sha2(F.concat(p["left"], own, p["right"]).cast("binary"), 256))


def siblings(proof: Column) -> Column:
    """The digests of a proof, level by level and left to right, joined."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), "")


def merkle_manifest(docs: DataFrame, *, extra: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, proof) of every row, and extra columns made of doc_id, source, lang, n_chars, text.

    A leaf is the digest of the five fields, each with its length, null apart from every value. Within a language leaves
    are ordered by doc_id, null first, and rows of equal doc_id by leaf; repeated rows are leaves of their own. Languages
    are ordered by their UTF-8 bytes, null first and apart from the empty one. One document alone is its own root. Texts
    are hashed whole, where they are read, and do not move. An empty table gives no rows. Columns other than the five are
    not looked at; of names that differ in case only, the one written alike is taken.
    """
    given = Narrow(docs, [], **{f"f_{f}": (f, lambda c: c) for f in FIELDS}).df
    fields = {f: F.col(f"f_{f}") for f in FIELDS}
    named = given.select(*[c.alias(f) for f, c in fields.items()])
    lang = F.col("lang").cast("string")
    tree = F.when(lang.isNull(), F.lit(b"")).otherwise(F.concat(F.lit(b"\x01"), lang.cast("binary")))
    more = {f"x_{k}": c for k, c in enumerate((extra or {}).values())}
    leaves = named.select(tree.alias("tree"), F.col("doc_id").alias("key"), leaf_of(*map(F.col, FIELDS)).alias("leaf"), *[c.alias(x) for x, c in more.items()])
    leaves = staged(numbered(leaves), "numbered")
    nodes = grown(leaves)
    tops = nodes.where("run = ''").select(F.lit(b"").alias("tree"), F.col("tree").alias("key"), F.col("digest").alias("leaf"))
    langs = staged(numbered(tops), "numbered")
    over = grown(langs)
    root = (over.where("run = ''").select("digest").first() or [None])[0]
    upper = proven(langs, over).select(F.col("key").alias("of"), F.col("leaf").alias("subroot"), F.col("proof").alias("upper"))
    made = proven(leaves, nodes).join(upper, F.col("tree") == F.col("of"))
    shown = F.when(F.col("tree") == F.lit(b""), F.lit(None)).otherwise(F.substring("tree", 2, 1 << 30).cast("string"))
    return made.select(F.col("key").alias("doc_id"), shown.alias("lang"), "leaf", "subroot", F.lit(root).cast("string").alias("root"), F.concat("proof", "upper").alias("proof"), *[F.col(x).alias(name) for x, name in zip(more, extra or {}, strict=True)])


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, and where they lead after some texts were tampered with."""
    text = F.col("text").cast("string")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate(text, UPPER, LOWER)).otherwise(text)
    changed = leaf_of(*[changed if f == "text" else F.col(f) for f in FIELDS])
    made = merkle_manifest(table(spark, sf_dir, "documents"), extra={"changed": changed})
    made = made.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), folded(F.col("changed"), F.col("proof")).alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, leaves: str, levels: int) -> str:
    """CTEs name_0 ... name_levels of (tree, i, d, n) and name_top (tree, d); name_j: of each leaf (tree, i) its steps."""
    out = [f"{name}_0 AS ({leaves})"]
    for k in range(1, levels + 1):
        out.append(f"{name}_{k} AS (SELECT tree, i // 8 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d, (n + 7) // 8 AS n FROM {name}_{k - 1} WHERE n > 1 GROUP BY tree, i // 8, n)")
    out.append(f"{name}_top AS (" + " UNION ALL ".join(f"SELECT tree, d FROM {name}_{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    steps = [f"SELECT a.tree, a.i, {k} AS k, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (WHERE b.i < a.i >> {3 * k}), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (WHERE b.i > a.i >> {3 * k}), '') AS r FROM {name}_0 a JOIN {name}_{k} b ON a.tree = b.tree AND a.i >> {3 * k + 3} = b.i >> 3 WHERE b.n > 1 GROUP BY a.tree, a.i" for k in range(levels)]
    out.append(f"{name}_j AS ({' UNION ALL '.join(steps)})")
    return ",\n".join(out)


def _oracle(levels: int = 7, over: int = 2) -> str:
    """SQL for up to 8 ** levels documents a language and 8 ** over languages; DuckDB has no crc32, so it is computed."""
    frame = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(frame(c) for c in FIELDS[:-1]) + f" || {frame(text)})"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    for_byte = f"list_reduce(range(8), lambda c, b: {step}, xor(c, ascii(b)))"
    crc = f"xor(list_reduce(string_split(CAST(doc_id AS VARCHAR), ''), lambda c, b: {for_byte}, 4294967295::BIGINT), 4294967295)".replace("lambda c, b: CASE", "lambda c, e: CASE")
    lower = f"CASE WHEN {crc} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
    return f"""
WITH RECURSIVE src AS (SELECT doc_id, lang, {leaf("text")} AS leaf, {leaf("changed")} AS was FROM (SELECT *, {lower} AS changed FROM documents)),
placed AS (SELECT *, coalesce('+' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM src),
{_tree_sql("t", "SELECT tree, i, leaf AS d, n FROM placed", levels)},
{_tree_sql("u", "SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, d, count(*) OVER () AS n FROM t_top", over)},
langs AS (SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS j FROM t_top),
steps AS (SELECT p.tree, p.i, k, l, r FROM placed p JOIN t_j ON p.tree = t_j.tree AND p.i = t_j.i
  UNION ALL SELECT p.tree, p.i, {levels} + u_j.k, u_j.l, u_j.r FROM placed p JOIN langs ON langs.tree = p.tree JOIN u_j ON u_j.i = langs.j),
paths AS (SELECT tree, i, sha256(string_agg(l || r, '' ORDER BY k)) AS proof, list(l ORDER BY k) AS ls, list(r ORDER BY k) AS rs FROM steps GROUP BY tree, i),
fold AS (SELECT tree, i, 1 AS k, was AS d FROM placed UNION ALL SELECT f.tree, f.i, f.k + 1, sha256(ls[f.k] || d || rs[f.k]) FROM fold f JOIN paths USING (tree, i) WHERE f.k <= len(ls)),
ends AS (SELECT tree, i, arg_max(d, k) AS d FROM fold GROUP BY tree, i)
SELECT doc_id, leaf, subroot, (SELECT d FROM u_top) AS root, coalesce(proof, sha256('')) AS proof_sha256, ends.d AS folded_root, ends.d = (SELECT d FROM u_top) AS verified
FROM placed JOIN langs USING (tree) JOIN ends USING (tree, i) LEFT JOIN paths USING (tree, i)
"""


OP12_SQL = _oracle()
