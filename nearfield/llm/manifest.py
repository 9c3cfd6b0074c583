"""A Merkle manifest of a vector table: a digest per row, a root, and every row's proof.

A row's leaf is the digest of its fields. Leaves of a ``part`` (a file, a
replica, any grouping of the rows) ascend by ``vec_id``; ``run`` consecutive
nodes become one until one is left, the part's subroot. Subroots, by part,
become the root in the same way. Proofs come by pointer jumping: a node holds
the siblings on the way to some ancestor; joining the nodes with themselves
doubles that way, and after as many joins as the logarithm of the height every
node's way ends at the root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from nearfield.runtime import BROADCAST_BYTES, materialize, positions, setting, write_table

RUN = 8
#: The fields of a point.
POINT_FIELDS = ("vec_id", "v")
_STEP = "struct<left:binary,right:binary,top:binary>"
_LEVEL = "node string, level int, tree string, at bigint, kids array<binary>, digest binary, cap boolean"


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _hex(digest) -> Column:
    return F.lower(F.hex(digest))


def record_digest(*fields) -> Column:
    """The digest of a row's fields: ``-`` for null, else byte count, ``:`` and the value as text.

    Hex SHA-256. Integers are decimal, lists as Spark writes them.
    """
    parts = []
    for field in fields:
        text = (F.col(field) if isinstance(field, str) else field).cast("string")
        size = F.octet_length(text).cast("string")
        parts.append(F.coalesce(F.concat(size, F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _key(tier: int, level, at, tree="tree") -> Column:
    return F.concat_ws("/", F.lit(tier), level, at, tree)


@dataclass
class _Trees:
    """Inner nodes of some trees, and ``tree, node, digest`` of what remains of each."""

    levels: DataFrame
    roots: DataFrame
    height: int


def _grow(leaves: DataFrame, tier: int, run: int) -> _Trees:
    """Build trees over ``tree, at, digest`` level by level, all trees by the same jobs.

    A tree ends in a cap: a node over a single first one, with its digest. Every
    other node is the digest of its kids. A task sees ``run`` nodes at a time.
    """
    spark = leaves.sparkSession
    nodes, paths = leaves, []
    while True:
        level = F.lit(len(paths) + 1)
        kids = F.array_sort(F.collect_list(F.struct("at", "digest")))
        up = nodes.groupBy("tree", F.floor(F.col("at") / run).cast("bigint").alias("up")).agg(kids.alias("kids"))
        up = up.select("tree", F.col("up").alias("at"), F.transform("kids", lambda k: k["digest"]).alias("kids"))
        cap = (F.col("at") == 0) & (F.size("kids") == 1)
        joined = F.array_join(F.transform("kids", _hex), "")
        digest = F.when(cap, F.col("kids")[0]).otherwise(_digest(joined))
        paths.append(
            write_table(
                up.select(
                    _key(tier, level, F.col("at")).alias("node"), level.alias("level"), "tree", "at",
                    "kids", digest.alias("digest"), cap.alias("cap"),
                ),
                "manifest-level",
            )
        )
        here = spark.read.schema(_LEVEL).parquet(paths[-1]).filter("not cap")
        if here.isEmpty():
            break
        nodes = here.select("tree", "at", "digest")
    levels = spark.read.schema(_LEVEL).parquet(*paths)
    return _Trees(levels, levels.filter("cap").select("tree", "node", "digest"), len(paths))


def _step(kids: Column, at: Column, cap: Column) -> Column:
    """The step from kid number ``at`` to its parent: the siblings, or the digest under a cap."""
    join = lambda part: F.unhex(F.array_join(F.transform(part, _hex), ""))
    left = join(F.slice(kids, F.lit(1), at))
    right = join(F.slice(kids, at + 2, F.greatest(F.size(kids) - at - 1, F.lit(0))))
    return F.when(cap, F.struct(F.lit(None), F.lit(None), kids[0]).cast(_STEP)).otherwise(
        F.struct(left, right, F.lit(None)).cast(_STEP)
    )


def _pointers(trees: _Trees, tier: int, run: int, inner: bool) -> DataFrame:
    """``node | at, proof, up``: one step for every kid, of inner nodes or of the leaves alone."""
    rows = trees.levels.filter("level > 1" if inner else "level = 1")
    rows = rows.select("node", "level", "tree", "at", "kids", "cap", F.posexplode("kids").alias("_i", "_kid"))
    at = F.col("at") * run + F.col("_i")
    proof = F.array(_step(F.col("kids"), F.col("_i"), F.col("cap"))).alias("proof")
    own = _key(tier, F.col("level") - 1, at).alias("node") if inner else at.alias("at")
    return rows.select(own, proof, F.col("node").alias("up"))


def _jump(pointers: DataFrame, height: int) -> DataFrame:
    """Double the way of every node until all of them end at the root.

    In round r an ancestor has at most ``run ** 2**r`` nodes below it, and ancestors are
    fewer than all nodes by that factor: either its group is small, or the
    ancestors are counted to fit the broadcast limit.
    """
    spark, reach = pointers.sparkSession, 1
    limit = setting(spark, BROADCAST_BYTES)
    while True:
        pointers = materialize(pointers, "manifest-pointers")
        if pointers.filter("up is not null").isEmpty():
            return pointers
        wanted = pointers.filter("up is not null").select(F.col("up").alias("node")).distinct()
        above = pointers.join(wanted, "node", "left_semi")
        above = above.select(F.col("node").alias("up"), F.col("proof").alias("_rest"), F.col("up").alias("_up"))
        # A step takes the digests of a run's other nodes, and some room for its structure.
        size = above.count() * min(reach, height) * (32 * RUN + 64)
        joined = pointers.join(F.broadcast(above) if size <= limit else above, "up", "left")
        rest = F.coalesce("_rest", F.array().cast(f"array<{_STEP}>"))
        pointers = joined.select("node", F.concat("proof", rest).alias("proof"), F.col("_up").alias("up"))
        reach *= 2


def merkle_proofs(leaves: DataFrame, keep: tuple[str, ...] = (), run: int = RUN) -> DataFrame:
    """Subroot, root and proof of every leaf: ``vec_id, part, leaf, [keep], subroot, root, proof``.

    ``leaves`` has ``vec_id bigint, part, leaf`` (hex) and the columns in
    ``keep``. Parts are ordered as text by their bytes, null first, and null is
    a part of its own. Inside a part rows ascend by ``vec_id``, null first;
    rows that share an id by ``leaf``; repeated rows stay, each with a leaf of
    its own. ``proof`` lists the steps to the root in order: the digests
    ``left`` and ``right`` of a node, none for a run of one, or ``top``, the
    subroot and the root where they are reached. A part with one row has that
    row's leaf as subroot. An empty table gives an empty one.

    Rows are numbered over range partitions, so a part with a third of all rows
    is shared by many tasks. Leaves join once, when their parents hold the
    whole way to the root.
    """
    if run < 2:
        raise ValueError("run must be at least 2")
    spark = leaves.sparkSession
    # A null part sorts before all others, an empty one after it.
    tree = F.coalesce(F.concat(F.lit("="), F.col("part").cast("string")), F.lit(""))
    # Kept columns travel in one, so that their names do not meet the operator's own.
    kept = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keep]).alias("_kept")
    rows = leaves.select("vec_id", "part", tree.alias("tree"), F.unhex("leaf").alias("digest"), kept)
    rows = materialize(rows, "manifest-leaves")
    numbered = positions(rows, ["tree"], ["vec_id", "digest"]).withColumn("at", F.col("pos") - 1).drop("pos")
    numbered = materialize(numbered, "manifest-order")

    parts = _grow(numbered.select("tree", "at", "digest"), 0, run)
    roots = parts.roots.select(F.lit("").alias("group"), "tree", "node", "digest")
    roots = materialize(positions(roots, ["group"], ["tree"]), "manifest-subroots")
    top = _grow(roots.select(F.lit("").alias("tree"), (F.col("pos") - 1).alias("at"), "digest"), 1, run)

    # The cap of a part goes on as a leaf of the top tree; the cap of that one is the root.
    onward = roots.select("node", (F.col("pos") - 1).alias("at")).join(_pointers(top, 1, run, False), "at")
    last = top.levels.filter("cap").select(
        "node", F.array().cast(f"array<{_STEP}>").alias("proof"), F.lit(None).cast("string").alias("up")
    )
    pointers = _pointers(parts, 0, run, True).unionByName(onward.drop("at"))
    pointers = pointers.unionByName(_pointers(top, 1, run, True)).unionByName(last)
    ways = _jump(pointers, parts.height + top.height)

    first = parts.levels.filter("level = 1").select("node", "kids", "cap").join(
        ways.select("node", F.col("proof").alias("_rest")), "node"
    )
    up = _key(0, F.lit(1), F.floor(F.col("at") / run).cast("bigint"))
    joined = numbered.withColumn("node", up).join(first, "node")
    step = _step(F.col("kids"), (F.col("at") % run).cast("int"), F.col("cap"))
    joined = joined.withColumn("proof", F.concat(F.array(step), F.col("_rest")))
    tops = F.transform(F.filter("proof", lambda s: s["top"].isNotNull()), lambda s: _hex(s["top"]))
    return joined.withColumn("_tops", tops).select(
        "vec_id", "part", _hex("digest").alias("leaf"), *[F.col("_kept")[c].alias(c) for c in keep],
        F.col("_tops")[0].alias("subroot"), F.col("_tops")[1].alias("root"), "proof",
    )


def proof_digest(proof="proof") -> Column:
    """The digest of all siblings of a proof, step by step, left to right."""
    siblings = F.filter(proof, lambda s: s["top"].isNull())
    return F.sha2(F.array_join(F.transform(siblings, lambda s: _hex(F.concat(s["left"], s["right"]))), ""), 256)


def fold_proof(leaf, proof="proof") -> Column:
    """The root that a leaf leads to by a proof; the true one if nothing was changed."""

    def climb(at, step):
        up = F.sha2(F.concat(_hex(step["left"]), at, _hex(step["right"])), 256)
        return F.when(step["top"].isNotNull(), at).otherwise(up)

    return F.aggregate(proof, F.col(leaf) if isinstance(leaf, str) else leaf, climb)


def point_manifest(points: DataFrame, part: str | None = None, fields: tuple[str, ...] = POINT_FIELDS) -> DataFrame:
    """The manifest of a table of points: ``vec_id, part, leaf, subroot, root, proof``.

    ``part`` names the column whose values have subtrees of their own; without
    it all points are one part. Columns that are not in ``fields`` do not count.
    """
    group = F.lit(None).cast("string") if part is None else F.col(part)
    return merkle_proofs(points.select("vec_id", group.alias("part"), record_digest(*fields).alias("leaf")))


def check_points(manifest: DataFrame, points: DataFrame, fields: tuple[str, ...] = POINT_FIELDS) -> DataFrame:
    """Which points still lead to the recorded root: ``vec_id, folded_root, verified``.

    ``points`` has one row per ``vec_id``; a point without a proof, or a proof
    without a point, is not verified.
    """
    now = points.select("vec_id", record_digest(*fields).alias("_now"))
    both = manifest.select("vec_id", "root", "proof").join(now, "vec_id", "full_outer")
    folded = fold_proof("_now").alias("folded_root")
    return both.select("vec_id", "root", folded).select(
        "vec_id", "folded_root", F.coalesce(F.col("folded_root") == F.col("root"), F.lit(False)).alias("verified")
    )
