"""A Merkle manifest of a dataset, with the proof of every row.

A row's leaf is the SHA-256 of its columns (each ``-`` if null, else its size in UTF-8
bytes, a colon and the value).  The leaves of a group ascend by id; every two neighbours
become their hash, one without a neighbour the hash of itself, until one is left: the
group's root.  The groups' roots, by name, give the dataset's root in the same way.

Places come from ranges of the sorted leaves and their counts, so no task holds a group.
The tree is built in tiers of ``HEIGHT`` levels: aligned blocks of 4,096 nodes are folded
where they lie, and their roots are the nodes of the next tier.  Proofs come down the
tiers: the proof of a block's root, a row, meets the block's nodes in one cogroup.  In
the block the paths of successive nodes are emitted by fractal traversal: subtrees of
``STEP`` levels are stacked, one existing and one desired at each height; the desired one
gets a node at its foot whenever the traversal has passed as many leaves as that node
covers, and takes over where the existing one ends.  So a task holds a block's digests and
a few subtrees, whatever the size of the table.

Edge cases: null ids come before all others, a null group is a group of its own before
all others.  Rows under one id stand by their leaves; equal rows have equal leaves, and
each has a place of its own.  Null, empty and very long values are hashed whole.  An
empty table gives no rows.  Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.storage import save, shuffle_partitions

#: Levels of a tier: a block has 2**HEIGHT nodes.
HEIGHT = 12
#: Levels of a stacked subtree.
STEP = 4
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Of every so many ids' checksums, one marks a row that op11 tampers with.
TAMPER_MODULUS = 7


def leaf_digest(columns: list[Column]) -> Column:
    """The 32 bytes that stand for a row with these values."""
    shown = [c.cast("string") for c in columns]
    parts = [F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in shown]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def node(*children: bytes) -> bytes:
    """Hash of nodes, in and out as lowercase hex in ASCII."""
    return sha256(b"".join(children)).hexdigest().encode()


def levels_in_block(n: int) -> int:
    """Levels that a block of a row of ``n`` nodes is folded by."""
    return min(HEIGHT, (n - 1).bit_length())


def folded(nodes: list[bytes], levels: int) -> bytes:
    for _ in range(levels):
        nodes = [node(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0]


class Subtree:
    """The nodes of levels ``low`` to ``high`` - 1 over a stretch of leaves, filled from the left."""

    def __init__(self, low: int, high: int, at: int):
        self.low, self.at = low, at << (high - low)  # at: place of its first node on level low
        self.rows: list[list[bytes]] = [[] for _ in range(low, high)]

    def grow(self, foot: bytes) -> None:
        """Add the next node at the foot, and above it what that completes."""
        for k, row in enumerate(self.rows):
            row.append(foot)
            if len(row) % 2 or k + 1 == len(self.rows):
                return
            foot = node(*row[-2:])

    def close(self) -> None:
        """No more nodes come: those without a neighbour are hashed alone."""
        for row, above in zip(self.rows, self.rows[1:]):
            if len(above) * 2 < len(row):
                above.append(node(*row[len(above) * 2 :]))

    def beside(self, level: int, place: int) -> bytes | None:
        k = level - self.low
        row, i = self.rows[k], (place ^ 1) - (self.at >> k)
        return row[i] if i < len(row) else None


def traverse(leaves: list[bytes], levels: int) -> Iterator[list[bytes | None]]:
    """The siblings of each leaf in turn, from the lowest of ``levels`` to the highest (None: it has none)."""
    n = len(leaves)
    heights = [(low, min(low + STEP, levels)) for low in range(0, levels, STEP)]

    def foot(low: int, place: int) -> bytes | None:
        start = place << low
        return folded(leaves[start : start + (1 << low)], low) if start < n else None

    def filled(low: int, high: int) -> Subtree:
        tree = Subtree(low, high, 0)
        for place in range(1 << (high - low)):
            if (x := foot(low, place)) is None:
                break
            tree.grow(x)
        tree.close()
        return tree

    existing = [filled(low, high) for low, high in heights]
    desired = [Subtree(low, high, 1) for low, high in heights]
    for i in range(n):
        for s, (low, high) in enumerate(heights):
            if i & ((1 << low) - 1):
                break  # nor has a higher subtree anything to do here
            if i and not i & ((1 << high) - 1):
                existing[s] = desired[s]
                existing[s].close()
                desired[s] = Subtree(low, high, (i >> high) + 1)
            if (x := foot(low, (i >> low) + (1 << (high - low)))) is not None:
                desired[s].grow(x)
        yield [existing[level // STEP].beside(level, i >> level) for level in range(levels)]


def climb(digest: bytes, sides: str, siblings: list[bytes]) -> bytes:
    """The root that a node and its siblings give; ``sides``: L and R where a sibling stands there, - where there is none."""
    rest = iter(siblings)
    for side in sides:
        digest = node(next(rest), digest) if side == "L" else node(digest, next(rest)) if side == "R" else node(digest)
    return digest


def _sides(place: int, siblings: list[bytes | None]) -> str:
    return "".join("-" if x is None else "L" if place >> level & 1 else "R" for level, x in enumerate(siblings))


def placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``idx``, the place in their group from 0, and ``n``, the group's size.

    Rows that are equal in all of this are kept apart by their place in the written table, so
    that copies do not meet in one range."""
    spread = rows.withColumn("tie", F.monotonically_increasing_id())
    laid = spread.repartitionByRange(shuffle_partitions(rows.sparkSession), group, *order, "tie").sortWithinPartitions(group, *order, "tie").drop("tie")
    laid = save(laid.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), name)
    # a row for each range and each further group in it
    counts = laid.groupBy(group, "part").agg(F.count(F.lit(1)).alias("here"), F.min("place").alias("first"))
    w = W.partitionBy(group)
    before = F.coalesce(F.sum("here").over(w.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(group, "part", (before - F.col("first")).alias("shift"), F.sum("here").over(w).alias("n"))
    return laid.join(offsets, [group, "part"]).withColumn("idx", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def _hexed(digests: pd.Series) -> list[bytes]:
    return [x.hex().encode() for x in digests]


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("idx", HEIGHT))


def _roots_of_blocks(nodes: DataFrame, name: str) -> DataFrame:
    """The next tier's nodes, (grp, idx, n, digest)."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        n = int(first["n"])
        root = folded(_hexed(frame.sort_values("idx")["digest"]), levels_in_block(n))
        return pd.DataFrame([(first["grp"], int(first["block"]), -(-n >> HEIGHT), bytes.fromhex(root.decode()))], columns=["grp", "idx", "n", "digest"])

    found = _blocks(nodes.select("grp", "idx", "n", "digest")).groupBy("grp", "block").applyInPandas(fold, "grp string, idx long, n long, digest binary")
    return save(found, name)


def _tiers(nodes: DataFrame, name: str) -> list[DataFrame]:
    """``nodes`` and the tiers above, up to one node for each group."""
    tiers = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        tiers.append(_roots_of_blocks(tiers[-1], name))
        most = -(-most >> HEIGHT)
    return tiers


def _paths(frame: pd.DataFrame) -> Iterator[tuple[int, str, list[bytes]]]:
    """(row, sides, siblings) within the block for the rows of a block in order."""
    for row, (place, beside) in enumerate(zip(frame["idx"].tolist(), traverse(_hexed(frame["digest"]), levels_in_block(int(frame["n"].iloc[0]))), strict=True)):
        yield row, _sides(place, beside), [x for x in beside if x is not None]


PROOF = "grp string, idx long, sides string, siblings binary, subroot binary, root binary"


def _proofs(nodes: DataFrame, above: DataFrame, name: str) -> DataFrame:
    """Proofs (``PROOF``) of a tier's nodes, given those of the next tier's."""

    def down(frame: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        frame, up = frame.sort_values("idx"), upper.iloc[0]
        rows = [
            (up["grp"], int(frame["idx"].iloc[row]), sides + up["sides"], bytes.fromhex(b"".join(beside).decode()) + up["siblings"], up["subroot"], up["root"])
            for row, sides, beside in _paths(frame)
        ]
        return pd.DataFrame(rows, columns=["grp", "idx", "sides", "siblings", "subroot", "root"])

    left = _blocks(nodes.select("grp", "idx", "n", "digest")).groupBy("grp", "block")
    right = above.withColumnRenamed("idx", "block").groupBy("grp", "block")
    return save(left.cogroup(right).applyInPandas(down, PROOF), name)


def manifest(docs: DataFrame, columns: list[str], group_col: str, id_col: str, probe: Column | None = None) -> DataFrame:
    """(id, leaf, subroot, root, sides, siblings_sha256, folded) of every row of ``docs``, digests as binary.

    ``probe`` is the leaf that is to be verified in place of the row's own (null: its own):
    ``folded`` is the root that it gives with the siblings of the row."""
    leaves = docs.select(
        # one string for a group: null first, then by bytes
        F.when(F.col(group_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group_col).cast("string"))).alias("grp"),
        F.col(id_col).alias("id"),
        leaf_digest([F.col(c) for c in columns]).alias("digest"),
        (F.lit(None).cast("binary") if probe is None else probe).alias("probe"),
    )
    tiers = _tiers(placed(save(leaves, "manifest-leaves"), "grp", ["id", "digest"], "manifest-places"), "manifest-tier")
    subroots = tiers[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    tops = placed(save(subroots, "manifest-subroots"), "grp", ["name"], "manifest-groups")
    upper = _tiers(tops, "manifest-upper")
    above = upper[-1].select("grp", "idx", F.lit("").alias("sides"), F.lit(b"").alias("siblings"), F.lit(b"").alias("subroot"), F.col("digest").alias("root"))
    for tier in reversed(upper[:-1]):
        above = _proofs(tier, above, "manifest-upper-proofs")
    named = tops.select("grp", "idx", "name", F.col("digest").alias("own"))
    above = named.join(above, ["grp", "idx"]).select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("idx"), "sides", "siblings", F.col("own").alias("subroot"), "root")
    for tier in reversed(tiers[1:-1]):
        above = _proofs(tier, above, "manifest-proofs")

    def emit(frame: pd.DataFrame, upper_rows: pd.DataFrame) -> pd.DataFrame:
        frame, up = frame.sort_values("idx", ignore_index=True), upper_rows.iloc[0]
        rest = up["siblings"].hex().encode()
        higher = [rest[i : i + 64] for i in range(0, len(rest), 64)]
        probes, own = frame["probe"].tolist(), frame["digest"].tolist()
        sides, proofs, roots = [], [], []
        for row, side, beside in _paths(frame):
            beside += higher
            sides.append(side + up["sides"])
            proofs.append(sha256(b"".join(beside)).digest())
            roots.append(bytes.fromhex(climb((own[row] if probes[row] is None else probes[row]).hex().encode(), sides[-1], beside).decode()))
        return pd.DataFrame({"id": frame["id"], "leaf": own, "subroot": [up["subroot"]] * len(own), "root": [up["root"]] * len(own), "sides": sides, "siblings_sha256": proofs, "folded": roots})

    kind = leaves.schema["id"].dataType.simpleString()
    schema = f"id {kind}, leaf binary, subroot binary, root binary, sides string, siblings_sha256 binary, folded binary"
    left, right = _blocks(tiers[0]).groupBy("grp", "block"), above.withColumnRenamed("idx", "block").groupBy("grp", "block")
    return left.cogroup(right).applyInPandas(emit, schema)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    more = [F.try_add("n_chars", F.lit(1)) if c == "n_chars" else F.col(c) for c in COLUMNS]
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_MODULUS == 0
    shown = lambda c: F.lower(F.hex(c))
    return manifest(docs, COLUMNS, "lang", "doc_id", F.when(marked, leaf_digest(more))).select(
        F.col("id").alias("doc_id"),
        shown("leaf").alias("leaf"),
        shown("subroot").alias("subroot"),
        shown("root").alias("root"),
        shown("siblings_sha256").alias("proof_sha256"),
        shown("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


#: CRC-32 and the two trees in SQL; list_reduce runs over the digits, then eight times over the bits.
ORACLE_SQL = """WITH RECURSIVE crc AS (
  SELECT DISTINCT doc_id, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) AS crc FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT documents.*, coalesce(crc % 7 = 0, false) AS marked FROM documents LEFT JOIN crc USING (doc_id)),
fields AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS grp, marked, n_chars,
  coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
  coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail FROM d),
hashed AS (SELECT doc_id, grp, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
  sha256(head || coalesce(length((n_chars + marked::INT)::VARCHAR) || ':' || (n_chars + marked::INT), '-') || tail) AS probe FROM fields),
base AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM hashed),
lower_tree AS (SELECT grp, 0 AS l, i, n, leaf AS h FROM base
  UNION ALL SELECT grp, l + 1, i // 2, (n + 1) // 2, sha256(h || coalesce(nx, '')) FROM (SELECT *, lead(h) OVER (PARTITION BY grp ORDER BY i) AS nx FROM lower_tree WHERE n > 1) WHERE i % 2 = 0),
subs AS (SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n FROM lower_tree WHERE n = 1),
upper_tree AS (SELECT 0 AS l, i, n, subroot AS h FROM subs
  UNION ALL SELECT l + 1, i // 2, (n + 1) // 2, sha256(h || coalesce(nx, '')) FROM (SELECT *, lead(h) OVER (ORDER BY i) AS nx FROM upper_tree WHERE n > 1) WHERE i % 2 = 0),
low_walk AS (SELECT grp, i AS leaf_i, i, 0 AS l, n, probe AS cur, '' AS sibs FROM base
  UNION ALL SELECT w.grp, leaf_i, w.i // 2, w.l + 1, (w.n + 1) // 2, sha256(CASE WHEN w.i % 2 = 1 THEN t.h || cur ELSE cur || coalesce(t.h, '') END), sibs || coalesce(t.h, '')
  FROM low_walk w LEFT JOIN lower_tree t ON t.grp = w.grp AND t.l = w.l AND t.i = xor(w.i, 1) WHERE w.n > 1),
walk AS (SELECT w.grp, leaf_i, s.i, 0 AS l, s.n, cur, sibs FROM low_walk w JOIN subs s USING (grp) WHERE w.n = 1
  UNION ALL SELECT w.grp, leaf_i, w.i // 2, w.l + 1, (w.n + 1) // 2, sha256(CASE WHEN w.i % 2 = 1 THEN t.h || cur ELSE cur || coalesce(t.h, '') END), sibs || coalesce(t.h, '')
  FROM walk w LEFT JOIN upper_tree t ON t.l = w.l AND t.i = xor(w.i, 1) WHERE w.n > 1)
SELECT b.doc_id, b.leaf, s.subroot, r.h AS root, sha256(w.sibs) AS proof_sha256, w.cur AS folded_root, w.cur = r.h AS verified
FROM base b JOIN subs s USING (grp) JOIN walk w ON w.grp = b.grp AND w.leaf_i = b.i AND w.n = 1 CROSS JOIN (SELECT h FROM upper_tree WHERE n = 1) r"""
