"""Merkle manifest of a dataset: a content-addressed DAG of digests, and proofs by descent from its root.

A leaf is the digest of a document's fields. Within a language leaves ascend by doc_id, and every ARITY consecutive nodes
of a level become their digest, until one is left. The languages' subroots grow the root in the same way. Every node
above the leaves is one record, digest to children, found by its digest alone.

Requests descend from the root. A leaf's rank in base ARITY has a digit for each level, and requests that share a prefix
of digits share a row until they part: a row holds the digest it stands at and, for each level passed, the digests beside
the child it took. A level is one join of these rows with the records of that level. At the last level the leaves meet
the run that they lie in, and the segments of the path, reversed, are the proof from leaf to root.

Ranks come from one range sort of digests and ids (no text is sorted): a row's place in its range and the sums of the
ranges before. A level holds ARITY times fewer rows than the one below, so all levels together cost less than the leaves.

Cases: null fields have a mark of their own; null doc_ids come first in their language and are never tampered with; a null
language is a language of its own, the first; rows that share a doc_id are leaves of their own in the order of their
digests; equal rows have equal leaves, whose records are kept once; a lone leaf is its subroot, a lone subroot the root; an
empty table has no root and no rows; texts of any length are digested whole; other columns, whatever their names, are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchflow.llm.common import stored, table

ARITY = 8
#: Rows in a range of the sort, and most ranges: beyond, ranges grow.
RANGE_ROWS, MOST_RANGES = 200_000, 10_000
_PATH = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A field as it enters a leaf: its number of bytes, a colon and the value, or a dash."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def height(n: Column) -> Column:
    """Levels above n leaves until one node is left: the digits of the last leaf's rank."""
    return F.when(n <= 1, 0).otherwise(F.length(F.conv((n - 1).cast("string"), 10, ARITY)))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows(grp, ...) with rank, from 0, of each row in its group, and the group's height."""
    ranges = min(max(1, rows.count() // RANGE_ROWS), MOST_RANGES)
    placed = rows.repartitionByRange(ranges, "grp", *order).sortWithinPartitions("grp", *order)
    placed = stored(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "manifest-ranks")
    found = placed.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # a row for each range, and one more for each group
    sums = found.selectExpr("grp as g", "part as p", "first", "sum(n) over (partition by grp) as size", "coalesce(sum(n) over (partition by grp order by part rows between unbounded preceding and 1 preceding), 0) as base")
    joined = placed.join(sums, F.col("grp").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return joined.select(*rows.columns, (F.col("base") + F.col("at") - F.col("first")).alias("rank"), height(F.col("size")).alias("height"))


@dataclass(frozen=True)
class Manifest:
    """records[k]: (digest, children) of the nodes k + 1 levels above the leaves; roots: (grp, digest, height)."""

    records: list[DataFrame]
    roots: DataFrame


def grow(leaves: DataFrame) -> Manifest:
    """leaves(grp, rank, height, digest), stored."""
    tallest = leaves.agg(F.coalesce(F.max("height"), F.lit(0))).first()[0]
    level = leaves.select("grp", "height", F.col("rank").alias("place"), "digest")
    roots, records = [level.filter("height = 0")], []
    for above in range(1, tallest + 1):
        runs = level.filter(F.col("height") >= above).groupBy("grp", "height", F.expr(f"place div {ARITY}").alias("place"))
        listed = runs.agg(F.sort_array(F.collect_list(F.struct(F.col("place").alias("at"), "digest"))).alias("run"))
        level = stored(listed.select("grp", "height", "place", F.sha2(F.array_join("run.digest", ""), 256).alias("digest"), F.col("run.digest").alias("children")), "manifest-level")
        # runs of equal leaves have one record
        records.append(level.groupBy("digest").agg(F.first("children").alias("children")))
        roots.append(level.filter(F.col("height") == above).select(*roots[0].columns))
    return Manifest(records, reduce(DataFrame.unionByName, roots).select("grp", "digest", "height"))


def _beside(children: Column, at: Column) -> Column:
    """The digests beside the child at a place."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), at), "").alias("before"), F.array_join(F.slice(children, at + 2, F.lit(ARITY)), "").alias("after"))


def descend(manifest: Manifest, starts: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(grp, rank, ...) with proof: what lies beside them and beside all nodes above, from the leaf's level up.

    starts(grp, digest, height, path): the roots, with the path that led to them."""
    begun = lambda above: starts.filter(F.col("height") == above).select("grp", F.lit(0).cast("long").alias("place"), "digest", "path")
    here = begun(len(manifest.records))
    for above in range(len(manifest.records), 0, -1):
        met = here.join(manifest.records[above - 1], "digest")
        if above == 1:
            here = met.select("grp", "place", "path", "children")
            break
        wanted = requests.select(F.col("grp").alias("g"), F.expr(f"rank div {ARITY ** (above - 1)}").alias("prefix")).distinct()
        below = met.select("grp", "place", "path", "children", F.posexplode("children").alias("digit", "digest"))
        below = below.select("grp", (F.col("place") * ARITY + F.col("digit")).alias("place"), "digest", F.concat("path", F.array(_beside(F.col("children"), F.col("digit")))).alias("path"))
        here = below.join(wanted, F.col("grp").eqNullSafe(F.col("g")) & (F.col("place") == F.col("prefix")), "left_semi").unionByName(begun(above - 1))
    lone = begun(0).select("grp", "place", "path", F.lit(None).cast("array<string>").alias("children"))
    ends = here.unionByName(lone) if manifest.records else lone
    ends = ends.select(F.col("grp").alias("g"), "place", "path", "children")
    joined = requests.join(ends, F.col("grp").eqNullSafe(F.col("g")) & (F.expr(f"rank div {ARITY}") == F.col("place")))
    last = F.when(F.col("children").isNull(), F.lit(None).cast(_PATH)).otherwise(F.array(_beside(F.col("children"), F.expr(f"CAST(rank % {ARITY} AS INT)"))))
    return joined.select(*requests.columns, F.reverse(F.concat("path", F.coalesce(last, F.array().cast(_PATH)))).alias("proof"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def prove(leaves: DataFrame) -> DataFrame:
    """leaves(grp, doc_id, digest, ...) with subroot, root and proof of each."""
    rows = stored(ranked(leaves, "doc_id", "digest"), "manifest-leaves")
    trees = grow(rows.select("grp", "rank", "height", "digest"))
    subroots = stored(trees.roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest", F.col("height").alias("own_height")), "manifest-subroots")
    tops = stored(ranked(subroots, "name"), "manifest-tops")
    top = grow(tops)
    nowhere = F.array().cast(_PATH).alias("path")
    found = descend(top, top.roots.select("grp", "digest", "height", nowhere), tops)
    root = top.roots.select(F.col("digest").alias("root"))  # one row, or none
    subs = found.join(F.broadcast(root)).select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), F.col("own_height").alias("height"), F.reverse("proof").alias("path"), "root")
    subs = stored(subs, "manifest-paths")
    proved = descend(trees, subs.select("grp", F.col("subroot").alias("digest"), "height", "path"), rows)
    names = subs.select(F.col("grp").alias("g"), "subroot", "root")
    return proved.join(names, F.col("grp").eqNullSafe(F.col("g"))).select(*leaves.columns, "subroot", "root", "proof")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = lambda text: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, digest(lowered))
    leaves = stored(docs.select(F.col("lang").alias("grp"), "doc_id", digest(F.col("text")).alias("digest"), tampered.alias("tampered")), "manifest-digests")
    proved = prove(leaves).withColumn("folded_root", folded(F.coalesce("tampered", "digest"), F.col("proof")))
    return proved.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _levels(source: str, name: str, most: int) -> dict[str, str]:
    """CTEs of a tree over source(g, r, n, d): <name>k holds the nodes k levels up, or the one that was left before, and
    <name>w for each leaf what lies before and after it at each level."""
    ctes = {f"{name}0": f"SELECT g, r, d, n FROM {source}"}
    for k in range(1, most + 1):
        ctes[f"{name}{k}"] = f"SELECT g, r // 8 AS r, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY r)) ELSE any_value(d) END AS d, (any_value(n) + 7) // 8 AS n, string_agg(d, '' ORDER BY r) AS run FROM {name}{k - 1} GROUP BY g, r // 8"
    before = [f"CASE WHEN w{k - 1}.n > 1 THEN left(w{k}.run, CAST(64 * (w{k - 1}.r % 8) AS BIGINT)) ELSE '' END AS b{k}, CASE WHEN w{k - 1}.n > 1 THEN substr(w{k}.run, CAST(64 * (w{k - 1}.r % 8) + 65 AS BIGINT)) ELSE '' END AS a{k}, w{k - 1}.n > 1 AS h{k}" for k in range(1, most + 1)]
    joins = " ".join(f"JOIN {name}{k} w{k} ON w{k}.g IS NOT DISTINCT FROM w0.g AND w{k}.r = w{k - 1}.r // 8" for k in range(1, most + 1))
    ctes[f"{name}w"] = f"SELECT w0.g, w0.r, {', '.join(before)}, w{most}.d AS top FROM {name}0 w0 {joins}"
    return ctes


def _fold(start: str, levels: list[tuple[str, int]]) -> str:
    for alias, k in levels:
        start = f"(SELECT CASE WHEN {alias}.h{k} THEN sha256({alias}.b{k} || x || {alias}.a{k}) ELSE x END FROM (SELECT {start} AS x))"
    return start


def _oracle(deep: int = 7, wide: int = 2) -> str:
    """The same as SQL, for languages of up to 8^deep documents and up to 8^wide languages."""
    part = "CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(part.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    path = [("t", k) for k in range(1, deep + 1)] + [("u", k) for k in range(1, wide + 1)]
    crc = "list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda x, b: xor(x >> 8, list_extract(bits, CAST((xor(x, b) & 255) + 1 AS BIGINT))))"
    ctes = {
        "crc": "SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS bits FROM (SELECT range AS i FROM range(256)) r",
        "leaves": f"SELECT doc_id, lang, {leaf('text')} AS d, CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {leaf('low')} ELSE {leaf('text')} END AS given FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents) t, crc",
        "src": "SELECT *, lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, d) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM leaves",
        **_levels("src", "lv", deep),
        "tops": f"SELECT 0 AS g, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS r, count(*) OVER () AS n, d, g AS name FROM lv{deep}",
        **_levels("tops", "up", wide),
    }
    beside = " || ".join(f"{a}.b{k} || {a}.a{k}" for a, k in path)
    rows = f"SELECT s.doc_id, s.d AS leaf, t.top AS subroot, u.top AS root, sha256({beside}) AS proof_sha256, {_fold('s.given', path)} AS folded_root FROM src s JOIN lvw t ON t.g IS NOT DISTINCT FROM s.g AND t.r = s.r JOIN tops p ON p.name IS NOT DISTINCT FROM s.g JOIN upw u ON u.r = p.r"
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + f"\nSELECT *, folded_root = root AS verified FROM ({rows}) f"


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLE = {"op11_merkle_manifest": _oracle()}
