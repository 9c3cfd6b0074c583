"""The same results as SQL for DuckDB, written from the definitions.

Common table expressions are kept in ``CTES`` by name with what they read;
``sql`` puts together the ones a query needs. Most partition tables hold for a
carving of one level, which ``checks.settings`` keeps on the test tables; the
deep ones are unrolled level by level.
"""

from __future__ import annotations

import re

from checks import settings as P
from checks.queries import SHUFFLED
from nearfield.functions.vectors import hyperplanes

CARVE, PRUNE, BEAM, K = P.CARVE, P.PRUNE, P.SEARCH.beam, P.K
PLANES = hyperplanes(PRUNE.hash_bits, P.DIM, PRUNE.seed)
CAP = 8 * PRUNE.max_degree


def _dot(a, b):
    return f"list_inner_product({a}, {b})"


def _l2(a, b):
    return f"power(list_distance({a}, {b}), 2)"


def _leader_count(n, frac, limit):
    return f"least(greatest(2, trunc(({n})::FLOAT * {frac}::FLOAT)::BIGINT), {limit}, ({n}))"


CTES = {
    "emb": "SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings",
    "anchored": """
        SELECT e.vec_id, e.label, e.v, f.vec_id AS anchor, f.v AS a FROM emb e
        JOIN (SELECT label, min(vec_id) AS anchor FROM emb GROUP BY label) m ON m.label = e.label
        JOIN emb f ON f.vec_id = m.anchor""",
    "pd": f"""
        SELECT a.vec_id AS src, b.vec_id AS dst, {_l2('a.v', 'b.v')} AS d,
               -{_dot('a.v', 'b.v')} AS ip
        FROM emb a, emb b""",
    "lead": f"""
        SELECT replica, vec_id, rn - 1 AS child FROM (
          SELECT r.replica, e.vec_id, row_number() OVER (
            PARTITION BY r.replica
            ORDER BY md5(concat({CARVE.seed} + r.replica, ':', e.vec_id)), e.vec_id) AS rn
          FROM emb e, (SELECT unnest(range(2)) AS replica) r)
        WHERE rn <= (SELECT {_leader_count('count(*)', CARVE.leader_frac, CARVE.max_leaders)} FROM emb)""",
    "asg": """
        SELECT replica, vec_id, child, leader FROM (
          SELECT l.replica, p.src AS vec_id, l.child, l.vec_id AS leader, row_number() OVER (
            PARTITION BY l.replica, p.src ORDER BY p.d, l.vec_id) AS rn
          FROM pd p JOIN lead l ON l.vec_id = p.dst) WHERE rn = 1""",
    "buckets": """
        SELECT replica, child, leader, count(*) AS n,
               row_number() OVER (PARTITION BY replica ORDER BY child) - 1 AS leaf_id
        FROM asg GROUP BY replica, child, leader""",
    "home": """
        SELECT a.replica, b.leaf_id, a.vec_id FROM asg a
        JOIN buckets b ON b.replica = a.replica AND b.child = a.child""",
    "near": """
        SELECT b.replica, p.src AS vec_id, b.leaf_id, b.child, row_number() OVER (
          PARTITION BY b.replica, p.src ORDER BY p.d, b.leader) AS rn
        FROM pd p JOIN buckets b ON b.leader = p.dst""",
    "extra": f"""
        SELECT replica, leaf_id, vec_id FROM (
          SELECT n.replica, n.leaf_id, n.vec_id, row_number() OVER (
            PARTITION BY n.replica, n.vec_id ORDER BY n.rn) AS k
          FROM near n ANTI JOIN home h
            ON h.replica = n.replica AND h.vec_id = n.vec_id AND h.leaf_id = n.leaf_id
          WHERE n.rn <= {CARVE.fanout}) WHERE k <= {CARVE.fanout - 1}""",
    "leaf": "SELECT * FROM home UNION ALL SELECT * FROM extra",
    "short": """
        SELECT replica, src, dst, first_leaf, row_number() OVER (
          PARTITION BY replica, src ORDER BY first_leaf, dst) AS rank
        FROM (SELECT a.replica, a.vec_id AS src, b.vec_id AS dst, min(a.leaf_id) AS first_leaf
              FROM leaf a JOIN leaf b ON a.replica = b.replica AND a.leaf_id = b.leaf_id
                AND a.vec_id <> b.vec_id
              GROUP BY a.replica, a.vec_id, b.vec_id)""",
    "scored": f"""
        SELECT s.replica, s.src, s.dst, p.d, row_number() OVER (
          PARTITION BY s.replica, s.src ORDER BY p.d, s.dst) AS rank
        FROM short s JOIN pd p ON p.src = s.src AND p.dst = s.dst WHERE s.rank <= {CAP}""",
    "scored_ip": """
        SELECT s.replica, s.src, s.dst, p.ip AS d, row_number() OVER (
          PARTITION BY s.replica, s.src ORDER BY p.ip, s.dst) AS rank
        FROM short s JOIN pd p ON p.src = s.src AND p.dst = s.dst""",
    "cand": "SELECT src, dst, d FROM cand_k12",
    "planes": "SELECT unnest(range({n})) AS bit, unnest({h}) AS h".format(
        n=len(PLANES), h="[" + ", ".join("[" + ", ".join(map(repr, h)) + "]" for h in PLANES) + "]"
    ),
    "proj": f"SELECT e.vec_id, p.bit, {_dot('p.h', 'e.v')} AS x FROM emb e, planes p",
    "hashed": """
        SELECT c.src, c.dst, c.d, sum(CASE WHEN t.x - s.x >= 0 THEN 1 << s.bit ELSE 0 END)::BIGINT AS hash
        FROM cand c JOIN proj s ON s.vec_id = c.src
        JOIN proj t ON t.vec_id = c.dst AND t.bit = s.bit GROUP BY c.src, c.dst, c.d""",
    "hash_graph": "SELECT src, dst, d, rank FROM hash_k12 WHERE rank <= 16",
    "refined_graph": "SELECT src, dst, d, rank FROM refined_k12 WHERE rank <= 16",
    "truth": f"""
        SELECT query_id, rank, vec_id FROM (
          SELECT src AS query_id, dst AS vec_id, row_number() OVER (
            PARTITION BY src ORDER BY d, dst) AS rank FROM pd) WHERE rank <= {K}""",
    "items": """
        SELECT src, dst, d, hash, row_number() OVER (PARTITION BY src ORDER BY dst) AS pos
        FROM hashed""",
    "prefix": f"""
        SELECT src, t, hash, best, rk FROM (
          SELECT *, row_number() OVER (PARTITION BY src, t ORDER BY best.d, best.dst) AS rk
          FROM (SELECT a.src, a.pos AS t, b.hash, min({{'d': b.d, 'dst': b.dst}}) AS best
                FROM items a JOIN items b ON a.src = b.src AND b.pos <= a.pos
                GROUP BY a.src, a.pos, b.hash)) WHERE rk <= {PRUNE.max_degree}""",
    "fate": f"""
        SELECT i.src, i.pos, n.t IS NOT NULL AS kept, o.t IS NOT NULL AS had,
               coalesce(f.n, 0) = {PRUNE.max_degree} AS full_before
        FROM items i
        LEFT JOIN prefix n ON n.src = i.src AND n.t = i.pos AND n.best.dst = i.dst
        LEFT JOIN prefix o ON o.src = i.src AND o.t = i.pos - 1 AND o.hash = i.hash
        LEFT JOIN (SELECT src, t, count(*) AS n FROM prefix GROUP BY src, t) f
          ON f.src = i.src AND f.t = i.pos - 1""",
    "counters": """
        SELECT src, 0 AS self_skipped, count_if(kept) AS kept, count_if(kept AND had) AS replaced,
               count_if(kept AND NOT had AND full_before) AS evicted, count_if(NOT kept) AS dropped,
               count_if(kept) - count_if(kept AND had)
                 - count_if(kept AND NOT had AND full_before) AS final_degree
        FROM fate GROUP BY src""",
    "totals": """
        SELECT sum(kept)::BIGINT AS prune_kept, sum(dropped)::BIGINT AS prune_dropped,
               sum(replaced)::BIGINT AS prune_replaced, sum(evicted)::BIGINT AS prune_evicted,
               sum(final_degree)::BIGINT AS prune_final_edges FROM counters""",
    "stats": """
        SELECT a.replica, leaf_count, assignment_total, min_leaf_size, max_leaf_size,
               points_with_overlap, max_membership, 0::BIGINT AS fallback_chunk_splits
        FROM (SELECT replica, count(*) AS leaf_count, sum(n)::BIGINT AS assignment_total,
                     min(n) AS min_leaf_size, max(n) AS max_leaf_size
              FROM (SELECT replica, leaf_id, count(*) AS n FROM leaf GROUP BY ALL) GROUP BY replica) a
        JOIN (SELECT replica, count_if(m > 1) AS points_with_overlap, max(m) AS max_membership
              FROM (SELECT replica, vec_id, count(*) AS m FROM leaf GROUP BY ALL) GROUP BY replica) b
          ON a.replica = b.replica""",
    "labels10": """
        SELECT label, vec_id, v, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (
          PARTITION BY label
          ORDER BY md5(concat(17, ':', printf('%08x', label), ':', vec_id)), vec_id) AS rn
        FROM emb""",
    "label_leaders": f"""
        SELECT label, rn - 1 AS child, vec_id, v FROM labels10
        WHERE rn <= {_leader_count('n', 0.1, 1000)}""",
    "label_assign": f"""
        SELECT label, vec_id, leader, child, d FROM (
          SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, leader) AS rn
          FROM (SELECT e.label, e.vec_id, l.vec_id AS leader, l.child, {_l2('e.v', 'l.v')} AS d
                FROM emb e JOIN label_leaders l ON l.label = e.label)) WHERE rn = 1""",
}


def _candidates(k: int) -> None:
    """Candidate edges at a leaf_k, and both graphs on them with full ranks."""
    CTES[f"cand_k{k}"] = f"""
        SELECT DISTINCT src, dst, d FROM (
          SELECT src, dst, d FROM scored WHERE replica = 0 AND rank <= {k}
          UNION ALL SELECT dst, src, d FROM scored WHERE replica = 0 AND rank <= {k})"""
    CTES[f"refined_k{k}"] = f"""
        SELECT src, dst, d, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank
        FROM cand_k{k}"""
    CTES[f"hashed_k{k}"] = CTES["hashed"].replace("FROM cand c", f"FROM cand_k{k} c")
    CTES[f"hash_k{k}"] = _hash_graph(f"hashed_k{k}")


def _hash_graph(hashed: str) -> str:
    return f"""
        SELECT src, best.dst AS dst, best.d AS d, row_number() OVER (
          PARTITION BY src ORDER BY best.d, best.dst) AS rank
        FROM (SELECT src, hash, min({{'d': d, 'dst': dst}}) AS best FROM {hashed} GROUP BY src, hash)"""


for _k in (4, 6, 8, 12):
    _candidates(_k)
# The shortlist of a degree-8 graph holds 64 entries.
CTES["scored_cap64"] = CTES["scored"].replace(f"<= {CAP}", "<= 64")
CTES["cand_k6_deg8"] = CTES["cand_k6"].replace("scored", "scored_cap64")
CTES["refined_k6_deg8"] = CTES["refined_k6"].replace("cand_k6", "cand_k6_deg8")
CTES["cand_r2"] = CTES["cand_k12"].replace("replica = 0 AND ", "")
CTES["hashed_r2"] = CTES["hashed"].replace("FROM cand c", "FROM cand_r2 c")


def _search(name: str, graph: str, degree: int, beam: int) -> None:
    """Best-first search from node 0 with lists as the state of a query."""
    CTES[f"links_{name}"] = f"""
        SELECT p.src AS q, g.src AS node, list({{'d': p.d, 'id': g.dst}}) AS nb
        FROM {graph} g JOIN pd p ON p.dst = g.dst WHERE g.rank <= {degree} GROUP BY p.src, g.src"""
    CTES[f"walk_{name}"] = f"""
        SELECT src AS q, 0 AS step, []::STRUCT(d DOUBLE, id BIGINT)[] AS done,
               [{{'d': d, 'id': dst}}] AS front
        FROM pd WHERE dst = 0
        UNION ALL
        SELECT w.q, w.step + 1, list_append(w.done, w.front[1]),
               list_sort(list_distinct(list_concat(w.front[2:], list_filter(
                 coalesce(n.nb, []), lambda x: NOT list_contains(list_append(w.done, w.front[1]), x)))))
        FROM walk_{name} w LEFT JOIN links_{name} n ON n.q = w.q AND n.node = w.front[1].id
        WHERE len(w.front) > 0 AND w.step < {beam}"""
    CTES[f"found_{name}"] = f"""
        SELECT q AS query_id, unnest(range(1, len(best) + 1)) AS rank, unnest(best).id AS vec_id,
               unnest(best).d AS d
        FROM (SELECT q, list_sort(arg_max(done, step))[1:{K}] AS best FROM walk_{name} GROUP BY q)"""
    CTES[f"recall_{name}"] = f"""
        SELECT avg(hits / {K}.0) AS recall FROM (
          SELECT t.query_id, count(f.vec_id) AS hits FROM truth t
          LEFT JOIN found_{name} f ON f.query_id = t.query_id AND f.vec_id = t.vec_id
          GROUP BY t.query_id)"""


_search("hash", "hash_k12", 16, BEAM)
_search("short", "hash_k12", 16, P.SHORT_SEARCH.beam)
_search("refined", "refined_k12", 16, BEAM)
_search("s0", "refined_k6_deg8", 8, 24)
_search("s1", "refined_k12", 16, 32)
_search("s2", "hash_k12", 16, 32)

# The second partition setting of the sweep: the same steps from leaders of its own.
_STEPS = ("lead", "asg", "buckets", "home", "near", "extra", "leaf", "short", "scored", "cand_k12",
          "refined_k12", "cand_r2", "hashed_r2")
for _name in _STEPS:
    _text = CTES[_name]
    if _name == "lead":
        _text = _text.replace(f"concat({CARVE.seed} +", f"concat({P.FINER.seed} +")
        _text = _text.replace(_leader_count("count(*)", CARVE.leader_frac, CARVE.max_leaders),
                              _leader_count("count(*)", P.FINER.leader_frac, P.FINER.max_leaders))
    if _name == "leaf":
        _text = "SELECT * FROM home"
    for _other in _STEPS:
        _text = re.sub(rf"\b(FROM|JOIN|,) {_other}\b", rf"\1 {_other}_finer", _text)
    CTES[f"{_name}_finer"] = _text
CTES["hashed_r2_finer"] = CTES["hashed_r2_finer"].replace("GROUP BY", "WHERE s.bit < 4 GROUP BY")
CTES["hash_finer"] = _hash_graph("hashed_r2_finer")
_search("s3", "refined_k12_finer", 16, 32)
_search("s4", "hash_finer", 16, 32)


CTES["exact_nn"] = f"""
    SELECT src, dst FROM (SELECT src, dst, row_number() OVER (
      PARTITION BY src ORDER BY d, dst) AS rank FROM pd WHERE src <> dst) WHERE rank <= {K}"""
CTES["run_graphs"] = " UNION ALL ".join(
    f"SELECT '{c.name}' AS name, '{c.mode}' AS method, {c.leaf_k} AS leaf_k, src, dst "
    f"FROM {c.mode}_k{c.leaf_k} WHERE rank <= {c.max_degree}"
    for c in P.RUNS
)
CTES["runs"] = f"""
    SELECT g.name, g.method, e.label::VARCHAR AS scale, g.leaf_k * any_value(n.n) / 1000.0::DOUBLE AS build_sec,
           round(count(x.dst) / (any_value(n.n) * {K}.0::DOUBLE), 6) AS recall_at_10,
           round(1e6::DOUBLE / count(*), 6) AS qps, count(*) AS edges
    FROM run_graphs g LEFT JOIN exact_nn x ON x.src = g.src AND x.dst = g.dst
    JOIN emb e ON e.vec_id = g.src
    JOIN (SELECT label, count(*)::DOUBLE AS n FROM emb GROUP BY label) n ON n.label = e.label
    GROUP BY g.name, g.method, g.leaf_k, e.label"""
CTES["cell_centres"] = f"""
    SELECT vec_id FROM (SELECT vec_id, row_number() OVER (
      ORDER BY md5(concat({P.CELL_SEED}, ':', vec_id)), vec_id) AS rn FROM emb)
    WHERE rn <= (SELECT ceil(sqrt(count(*))) FROM emb)"""
CTES["cell_rank"] = """
    SELECT p.src AS query_id, p.dst AS cell, row_number() OVER (
      PARTITION BY p.src ORDER BY p.d, p.dst) AS rn
    FROM pd p JOIN cell_centres c ON c.vec_id = p.dst"""
CTES["cells"] = "SELECT query_id AS vec_id, cell FROM cell_rank WHERE rn = 1"
CTES["cell_sample"] = f"""
    SELECT vec_id FROM emb ORDER BY md5(concat('probe:', vec_id)), vec_id LIMIT {P.CELL_SAMPLE}"""
CTES["cell_scale"] = "SELECT max(abs(x)) AS s FROM (SELECT unnest(v) AS x FROM emb)"
CTES["cell_codes"] = """
    SELECT vec_id, list_transform(v, lambda x: floor(x / s * 127 + 0.5::DOUBLE)::DOUBLE) AS c,
           list_transform(v, lambda x: x / s * 127) AS q
    FROM emb, (SELECT s FROM cell_scale)"""
CTES["code_rank"] = f"""
    SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (
      PARTITION BY a.vec_id ORDER BY {_l2('a.q', 'b.c')}, b.vec_id) AS rn
    FROM cell_codes a JOIN cell_codes b ON true"""
CTES["cell_need"] = f"""
    SELECT r.rn AS rank, ceil(o.rn / {K}.0::DOUBLE) AS need
    FROM truth t JOIN cell_sample s ON s.vec_id = t.query_id
    JOIN cells c ON c.vec_id = t.vec_id
    JOIN code_rank o ON o.query_id = t.query_id AND o.vec_id = t.vec_id
    JOIN cell_rank r ON r.query_id = t.query_id AND r.cell = c.cell"""
CTES["cell_factor"] = f"""
    SELECT coalesce(min(f), {P.CELL_FACTORS[-1]}) AS f FROM (SELECT unnest({list(P.CELL_FACTORS)}) AS f)
    WHERE (SELECT count(*) FROM cell_need WHERE need <= f) >= 0.99::DOUBLE * (SELECT count(*) FROM cell_need)"""
CTES["cell_probes"] = f"""
    SELECT rank AS probes, met / total AS recall FROM (
      SELECT rank, sum(n) OVER (ORDER BY rank)::DOUBLE AS met FROM (
        SELECT rank, count(*) AS n FROM cell_need WHERE need <= (SELECT f FROM cell_factor) GROUP BY rank)),
      (SELECT count(*)::DOUBLE AS total FROM cell_need)
    WHERE met >= {P.CELL_RECALL}::DOUBLE * total ORDER BY rank LIMIT 1"""
CTES["probed"] = """
    SELECT query_id, cell FROM cell_rank WHERE rn <= (SELECT probes FROM cell_probes)"""
CTES["cell_short"] = f"""
    SELECT query_id, vec_id FROM (
      SELECT q.query_id, c.vec_id, row_number() OVER (PARTITION BY q.query_id ORDER BY o.rn) AS k
      FROM probed q JOIN cells c ON c.cell = q.cell
      JOIN code_rank o ON o.query_id = q.query_id AND o.vec_id = c.vec_id)
    WHERE k <= {K} * (SELECT f FROM cell_factor)"""
CTES["cell_found"] = f"""
    SELECT query_id, vec_id, d, rank FROM (
      SELECT q.query_id, q.vec_id, p.d, row_number() OVER (
        PARTITION BY q.query_id ORDER BY p.d, q.vec_id) AS rank
      FROM cell_short q JOIN pd p ON p.src = q.query_id AND p.dst = q.vec_id) WHERE rank <= {K}"""

LEVELS = 8  # deep carvings of the test tables end before


def _deep(tag: str, emb: str, carve) -> None:
    """A carving of several levels, its routing and statistics, every level a table of its own."""
    CTES[f"pd_{tag}"] = f"SELECT a.vec_id AS src, b.vec_id AS dst, {_l2('a.v', 'b.v')} AS d FROM {emb} a, {emb} b"
    CTES[f"in_{tag}_0"] = f"""
        SELECT printf('%08x', r.replica) AS parent, r.replica, vec_id FROM {emb},
          (SELECT unnest(range(2)) AS replica) r"""
    for at in range(LEVELS):
        name = lambda table: f"{table}_{tag}_{at}"
        CTES[name("lead")] = f"""
            SELECT parent, vec_id, rn - 1 AS child FROM (
              SELECT parent, vec_id, count(*) OVER (PARTITION BY parent) AS n, row_number() OVER (
                PARTITION BY parent ORDER BY md5(concat({carve.seed} + replica, ':', substr(parent, 9),
                  CASE WHEN length(parent) > 8 THEN ':' ELSE '' END, vec_id)), vec_id) AS rn
              FROM {name("in")})
            WHERE rn <= {_leader_count('n', carve.leader_frac, carve.max_leaders)}"""
        CTES[name("asg")] = f"""
            SELECT replica, parent, vec_id, child, leader FROM (
              SELECT m.replica, m.parent, m.vec_id, l.child, l.vec_id AS leader, row_number() OVER (
                PARTITION BY m.parent, m.vec_id ORDER BY p.d, l.vec_id) AS rn
              FROM {name("in")} m JOIN {name("lead")} l ON l.parent = m.parent
              JOIN pd_{tag} p ON p.src = m.vec_id AND p.dst = l.vec_id) WHERE rn = 1"""
        CTES[name("buckets")] = f"""
            SELECT parent, child, representative, concat(parent, printf('%08x', child)) AS path,
                   CASE WHEN n = sum(n) OVER (PARTITION BY parent) THEN 'chunk'
                        WHEN n <= {carve.cmax} THEN 'leaf' ELSE 'split' END AS fate
            FROM (SELECT parent, child, min(leader) AS representative, count(*) AS n
                  FROM {name("asg")} GROUP BY parent, child)"""
        CTES[name("rows")] = f"""
            SELECT a.replica, a.parent, a.vec_id, b.path, b.fate FROM {name("asg")} a
            JOIN {name("buckets")} b ON b.parent = a.parent AND b.child = a.child"""
        CTES[name("runs")] = f"""
            SELECT replica, parent, vec_id, concat(parent, printf('%08x', (row_number() OVER (
              PARTITION BY parent ORDER BY vec_id) - 1) // {carve.cmax})) AS path
            FROM {name("rows")} WHERE fate = 'chunk'"""
        CTES[f"in_{tag}_{at + 1}"] = f"""
            SELECT path AS parent, replica, vec_id FROM {name("rows")} WHERE fate = 'split'"""
    every = lambda text: " UNION ALL ".join(text.format(f"{tag}_{at}") for at in range(LEVELS))
    CTES[f"nodes_{tag}"] = every("""
        SELECT path, parent, representative, fate = 'leaf' AS is_leaf, false AS chunked
        FROM buckets_{0} WHERE fate <> 'chunk'
        UNION ALL SELECT path, parent, min(vec_id), true, true FROM runs_{0} GROUP BY path, parent""")
    CTES[f"home_{tag}"] = every("""
        SELECT replica, path, vec_id FROM rows_{0} WHERE fate = 'leaf'
        UNION ALL SELECT replica, path, vec_id FROM runs_{0}""")
    CTES[f"at_{tag}_0"] = f"""
        SELECT vec_id, rank, path, is_leaf FROM (
          SELECT p.src AS vec_id, n.path, n.is_leaf, row_number() OVER (
            PARTITION BY n.parent, p.src ORDER BY p.d, n.representative) AS rank
          FROM pd_{tag} p JOIN nodes_{tag} n ON n.representative = p.dst AND length(n.parent) = 8)
        WHERE rank <= 3"""
    for at in range(LEVELS):
        CTES[f"at_{tag}_{at + 1}"] = f"""
            SELECT vec_id, rank, path, is_leaf FROM at_{tag}_{at} WHERE is_leaf
            UNION ALL SELECT vec_id, rank, path, is_leaf FROM (
              SELECT a.vec_id, a.rank, n.path, n.is_leaf, row_number() OVER (
                PARTITION BY a.vec_id, a.path ORDER BY p.d, n.representative) AS rn
              FROM at_{tag}_{at} a JOIN nodes_{tag} n ON n.parent = a.path
              JOIN pd_{tag} p ON p.src = a.vec_id AND p.dst = n.representative
              WHERE NOT a.is_leaf) WHERE rn = 1"""
    CTES[f"routed_{tag}"] = f"""
        SELECT vec_id, ('0x' || left(path, 8))::INT AS replica, rank, path FROM at_{tag}_{LEVELS}"""
    CTES[f"leaf_{tag}"] = f"""
        SELECT replica::INT AS replica, path, vec_id FROM home_{tag}
        UNION ALL SELECT replica, path, vec_id FROM (
          SELECT *, row_number() OVER (PARTITION BY replica, vec_id ORDER BY rank) AS k
          FROM routed_{tag} r ANTI JOIN home_{tag} h ON h.path = r.path AND h.vec_id = r.vec_id)
        WHERE k <= least({carve.fanout}, (SELECT count(*) FROM nodes_{tag} n
          WHERE n.parent = printf('%08x', replica))) - 1"""
    CTES[f"stats_{tag}"] = f"""
        SELECT a.replica, leaf_count, assignment_total, min_leaf_size, max_leaf_size,
               points_with_overlap, max_membership, coalesce(c.chunks, 0) AS fallback_chunk_splits
        FROM (SELECT replica, count(*) AS leaf_count, sum(n)::BIGINT AS assignment_total,
                     min(n) AS min_leaf_size, max(n) AS max_leaf_size
              FROM (SELECT replica, path, count(*) AS n FROM leaf_{tag} GROUP BY ALL) GROUP BY replica) a
        JOIN (SELECT replica, count_if(m > 1) AS points_with_overlap, max(m) AS max_membership
              FROM (SELECT replica, vec_id, count(*) AS m FROM leaf_{tag} GROUP BY ALL) GROUP BY replica) b
          ON a.replica = b.replica
        LEFT JOIN (SELECT ('0x' || left(path, 8))::INT AS replica, count(*) AS chunks FROM nodes_{tag}
                   WHERE chunked GROUP BY 1) c ON c.replica = a.replica"""


CTES["crowded"] = """
    SELECT e.vec_id, CASE WHEN e.vec_id % 3 = 0 THEN f.v ELSE e.v END AS v
    FROM emb e JOIN emb f ON f.vec_id = 0"""
_deep("deep", "emb", P.DEEP)
_deep("crowded", "crowded", P.DEEP)

# The same partition, candidates and graph under the inner-product score.
_IP = ("asg", "buckets", "home", "near", "extra", "leaf", "short", "scored", "cand_k12", "refined_k12")
for _name in _IP:
    _text = re.sub(r"\bp\.d\b", "p.ip", CTES[_name]).replace("p.ip,", "p.ip AS d,", 1)
    if _name != "scored":
        _text = re.sub(r"\bp\.d\b", "p.ip", CTES[_name])
    for _other in _IP:
        _text = re.sub(rf"\b(FROM|JOIN) {_other}\b", rf"\1 {_other}_by_ip", _text)
    CTES[f"{_name}_by_ip"] = _text

_NAMES = re.compile(r"\b(?:FROM|JOIN|,)\s+([a-z_0-9]+)", re.S)


def _needs(body: str) -> list[str]:
    return [n for n in dict.fromkeys(_NAMES.findall(body)) if n in CTES]


def sql(body: str) -> str:
    """``body`` with the table expressions it needs, each before its readers."""
    ordered: list[str] = []

    def visit(name, inside=()):
        if name in ordered or name in inside:
            return
        for other in _needs(CTES[name]):
            visit(other, (*inside, name))
        ordered.append(name)

    for name in _needs(body):
        visit(name)
    if not ordered:
        return body
    parts = ",\n".join(
        f"{n} AS {'' if n.startswith('walk_') else 'MATERIALIZED '}({CTES[n]})" for n in ordered
    )
    return f"WITH RECURSIVE {parts}\n{body}"


_RANKED = "SELECT src, dst, rank, round(d, 6) AS d FROM"
_PER_REPLICA = "SELECT replica::INT AS replica, src, dst, rank, round(d, 6) AS d FROM"

ORACLE = {
    "s1_read_fvecs": f"""SELECT vec_id, len(v)::INT AS dim, round({_dot('v', 'v')}, 6) AS norm,
        v[1] AS first FROM emb""",
    "s2_read_ivecs": "SELECT query_id, rank, vec_id FROM truth",
    "s5_read_vectors": "SELECT count(*) AS n, max(vec_id) AS last_id, max(len(v))::INT AS dim FROM emb",
    "s6_row_limit": f"""SELECT vec_id, round({_dot('v', 'v')}, 6) AS norm FROM emb
        WHERE vec_id < {P.ROW_LIMIT}""",
    "s7_vector_file_inventory": """SELECT 'fbin' AS kind, len(any_value(v))::BIGINT AS dim,
        true AS consistent, count(*) AS vectors, sum(4 * len(v))::BIGINT AS payload_bytes FROM emb""",
    "s8_synthetic_vectors": f"""SELECT vec_id, axis::INT AS axis, round(sqrt(-2.0 * ln(
          (('0x' || substr(h, 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE))
          * cos(2 * pi() * (('0x' || substr(h, 9, 8))::BIGINT / 4294967296.0::DOUBLE)), 6) AS x
        FROM (SELECT vec_id, axis, md5(concat({P.SYNTHETIC_SEED}, ':', vec_id, ':', axis)) AS h
              FROM embeddings, (SELECT unnest(range(8)) AS axis))""",
    "s9_table_source": "SELECT vec_id, len(v)::INT AS dim, round(list_sum(v), 6) AS total FROM emb",
    "s10_metrics_json": """SELECT name AS mode, round(build_sec, 6) AS build_sec, recall_at_10,
        round(qps, 6) AS qps, edges FROM runs""",
    "s11_summary_tsv": """SELECT concat(name, '@', scale) AS name, method AS mode,
        round(build_sec, 6) AS build_sec, recall_at_10, round(qps, 6) AS qps, edges FROM runs""",
    "v1_l2_squared": f"SELECT vec_id, anchor, round({_l2('v', 'a')}, 6) AS d FROM anchored",
    "v2_dot": f"SELECT vec_id, anchor, round({_dot('v', 'a')}, 6) AS p FROM anchored",
    "v3_metric_score": f"""SELECT vec_id, round({_l2('v', 'a')}, 6) AS l2,
        round(-{_dot('v', 'a')}, 6) AS ip FROM anchored""",
    "v4_dimension_guard": f"""SELECT label, count(*) AS n, round(sum({_dot('v', 'v')}), 6) AS norm
        FROM emb GROUP BY label""",
    "v5_clamp_distance": f"""SELECT vec_id, round(CASE WHEN d < 0 AND d > -1e-4 THEN 0 ELSE d END, 9) AS d
        FROM (SELECT vec_id, round({_dot('v', 'a')}, 6) / 10000.0::DOUBLE - 0.00005::DOUBLE AS d FROM anchored)""",
    "v6_l2_from_norms": f"SELECT vec_id, round({_l2('v', 'a')}, 6) AS d FROM anchored",
    "v7_residual_hash": """SELECT a.anchor AS src, a.vec_id AS dst,
        sum(CASE WHEN t.x - s.x >= 0 THEN 1 << s.bit ELSE 0 END)::BIGINT AS hash
        FROM anchored a JOIN proj s ON s.vec_id = a.anchor
        JOIN proj t ON t.vec_id = a.vec_id AND t.bit = s.bit GROUP BY a.anchor, a.vec_id""",
    "v7_residual_hash_equal": f"""SELECT vec_id AS src, -vec_id - 1 AS dst,
        {(1 << PRUNE.hash_bits) - 1}::BIGINT AS hash FROM emb""",
    "v8_hyperplanes": "SELECT vec_id, bit::INT AS bit, round(x, 6) AS x FROM proj",
    "v9_qps": """SELECT event_type, day, round(n / greatest(1e-6, sec), 6) AS qps FROM (
        SELECT event_type, ts::DATE::VARCHAR AS day, count(*) AS n,
               (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE AS sec
        FROM events GROUP BY event_type, ts::DATE)""",
    "v10_valid_edges": """SELECT src, dst FROM (
        SELECT vec_id AS src, vec_id * 2 - label * 3 AS dst FROM embeddings)
        WHERE src <> dst AND dst IN (SELECT vec_id FROM embeddings)""",
    "k1_exact_topk_l2": f"""SELECT query_id, rank, vec_id, round(d, 6) AS d FROM (
        SELECT src AS query_id, dst AS vec_id, d, row_number() OVER (
          PARTITION BY src ORDER BY d, dst) AS rank FROM pd) WHERE rank <= {K}""",
    "k1_exact_topk_ip": f"""SELECT query_id, rank, vec_id, round(ip, 6) AS d FROM (
        SELECT src AS query_id, dst AS vec_id, ip, row_number() OVER (
          PARTITION BY src ORDER BY ip, dst) AS rank FROM pd) WHERE rank <= {K}""",
    "k2_exact_knn_graph": """SELECT src, dst, rank, round(d, 6) AS d FROM (
        SELECT src, dst, d, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank
        FROM pd WHERE src <> dst) WHERE rank <= 32""",
    "k3_ground_truth": f"""SELECT query_id, rank, vec_id FROM (
        SELECT src AS query_id, dst AS vec_id, row_number() OVER (
          PARTITION BY src ORDER BY ip, dst) AS rank FROM pd) WHERE rank <= {K}""",
    "p1_leader_count": f"""SELECT label, n, {_leader_count('n', CARVE.leader_frac, CARVE.max_leaders)} AS leaders
        FROM (SELECT label, count(*) AS n FROM emb GROUP BY label)""",
    "p2_sample_leaders": "SELECT label, child, vec_id FROM label_leaders",
    "p3_assign_to_leaders": "SELECT vec_id, leader, child, round(d, 6) AS d FROM label_assign",
    "p4_bucket_split": """SELECT a.label, a.child, count(*) AS n, min(a.leader) AS representative,
        CASE WHEN count(*) = any_value(g.n) THEN 'chunk' WHEN count(*) <= 16 THEN 'leaf' ELSE 'split' END AS fate
        FROM label_assign a JOIN (SELECT label, count(*) AS n FROM emb GROUP BY label) g ON g.label = a.label
        GROUP BY a.label, a.child""",
    "p5_carve": "SELECT replica::INT AS replica, child, vec_id FROM asg",
    "p6_chunk_split": """SELECT label, chunk, min(vec_id) AS representative, count(*) AS n FROM (
        SELECT label, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 7 AS chunk
        FROM emb) GROUP BY label, chunk""",
    "p7_leaf_numbers": "SELECT replica::INT AS replica, leaf_id, leader AS representative FROM buckets",
    "p8_nearest_children": """SELECT replica::INT AS replica, vec_id, rn::INT AS rank, child FROM near
        WHERE rn <= 3""",
    "p9_route_at_leaf": "SELECT replica::INT AS replica, child, leader AS vec_id FROM buckets",
    "p5_carve_deep": "SELECT path, parent, representative, is_leaf FROM nodes_deep",
    "p5_carve_crowded": "SELECT path, parent, representative, is_leaf, chunked FROM nodes_crowded",
    "p9_route_to_leaf": "SELECT vec_id, replica, rank::INT AS rank, path FROM routed_deep",
    "p9_route_crowded": "SELECT vec_id, replica, rank::INT AS rank, path FROM routed_crowded",
    "p13_build_partition_deep": "SELECT * FROM stats_deep",
    "p13_build_partition_crowded": "SELECT * FROM stats_crowded",
    "p10_overlap": "SELECT replica::INT AS replica, leaf_id, vec_id FROM leaf",
    "p11_point_memberships": """SELECT replica::INT AS replica, vec_id,
        string_agg(leaf_id, ',' ORDER BY leaf_id) AS leaf_ids FROM leaf GROUP BY replica, vec_id""",
    "p12_partition_stats": "SELECT replica::INT AS replica, * EXCLUDE (replica) FROM stats",
    "p13_build_partition": """SELECT leaf_id, count(*) AS size, min(vec_id) AS first_id,
        sum(vec_id)::BIGINT AS id_sum FROM leaf WHERE replica = 0 GROUP BY leaf_id""",
    "c1_shortlist": "SELECT replica::INT AS replica, src, rank, dst FROM short",
    "c2_cap_shortlist": "SELECT replica::INT AS replica, src, rank, dst FROM short WHERE rank <= 128",
    "c3_score_shortlist": f"{_PER_REPLICA} scored WHERE rank <= 12",
    "c3_score_uncapped_ip": f"{_PER_REPLICA} scored_ip WHERE rank <= 12",
    "c4_bidirect": """SELECT replica::INT AS replica, src, dst, round(d, 6) AS d FROM scored WHERE rank <= 4
        UNION ALL SELECT replica::INT, dst, src, round(d, 6) FROM scored WHERE rank <= 4""",
    "c5_union_replicas": "SELECT src, dst, round(d, 6) AS d FROM cand_r2",
    "c6_candidate_stats": """SELECT sum(leaf_count)::BIGINT AS num_leaves,
        sum(assignment_total)::BIGINT AS partition_assignment_total,
        sum(points_with_overlap)::BIGINT AS partition_points_with_overlap,
        max(max_membership) AS partition_max_membership, min(min_leaf_size) AS partition_min_leaf_size,
        max(max_leaf_size) AS partition_max_leaf_size, 0::BIGINT AS partition_fallback_chunk_splits,
        (SELECT 2 * count(*) FROM scored WHERE rank <= 12) AS candidate_edges FROM stats""",
    "c7_leaf_knn_exact": """SELECT replica::INT AS replica, leaf_id, src, dst, round(d, 6) AS d FROM (
        SELECT replica, leaf_id, src, dst, d FROM leafnn WHERE rk <= 6
        UNION ALL SELECT replica, leaf_id, dst, src, d FROM leafnn WHERE rk <= 6)""",
    "c8_leaf_knn_capped": f"""SELECT replica::INT AS replica, leaf_id, src, dst, round(d, 6) AS d FROM (
        SELECT *, row_number() OVER (PARTITION BY replica, leaf_id, src ORDER BY d, dst) AS rk FROM (
          SELECT *, row_number() OVER (PARTITION BY replica, leaf_id, src ORDER BY off) AS seen FROM (
            SELECT a.replica, a.leaf_id, a.vec_id AS src, b.vec_id AS dst, p.d,
                   (b.pos - (a.pos * 2654435761 % 4294967296) % a.m + a.m) % a.m AS off
            FROM numbered a JOIN numbered b ON a.replica = b.replica AND a.leaf_id = b.leaf_id
              AND a.vec_id <> b.vec_id JOIN pd p ON p.src = a.vec_id AND p.dst = b.vec_id)) WHERE seen <= {P.SCAN_CAP})
        WHERE rk <= 4""",
    "c9_leaf_knn_blocked": "SELECT replica::INT AS replica, leaf_id, src, dst FROM leafnn WHERE rk <= 6",
    "g1_hash_prune": f"{_RANKED} hash_graph",
    "g2_prune_counters": "SELECT * REPLACE (self_skipped::BIGINT AS self_skipped) FROM counters",
    "g3_prune_totals": "SELECT * FROM totals",
    "g4_refine_degree": """SELECT src, dst, rank, round(ip, 6) AS d FROM (
        SELECT c.src, c.dst, p.ip, row_number() OVER (PARTITION BY c.src ORDER BY p.ip, c.dst) AS rank
        FROM cand c JOIN pd p ON p.src = c.src AND p.dst = c.dst) WHERE rank <= 8""",
    "g5_build_graph_hashprune": f"{_RANKED} ({_hash_graph('hashed_r2')}) WHERE rank <= 16",
    "g6_build_graph_refined": f"{_RANKED} refined_k12_by_ip WHERE rank <= 16",
    "g7_build_graph_exact": """SELECT src, dst, rank, round(d, 6) AS d FROM (
        SELECT src, dst, d, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank
        FROM pd WHERE src <> dst) WHERE rank <= 16""",
    "g8_adjacency": """SELECT e.vec_id AS src, coalesce(string_agg(g.dst, ',' ORDER BY g.rank), '') AS nbrs,
        count(g.dst)::INT AS degree FROM emb e LEFT JOIN hash_graph g ON g.src = e.vec_id GROUP BY e.vec_id""",
    "g8_edge_count": """SELECT (SELECT count(*) FROM hash_graph) AS edges,
        (SELECT count(*) FROM emb) AS nodes""",
    "q1_beam_search": "SELECT query_id, rank::INT AS rank, vec_id, round(d, 6) AS d FROM found_hash",
    "q2_search_refined_graph": """SELECT query_id, rank::INT AS rank, vec_id, round(d, 6) AS d
        FROM found_refined""",
    "q3_approx_baseline": "SELECT query_id, rank, vec_id, round(d, 6) AS d FROM cell_found",
    "q3_cell_index": f"""SELECT (SELECT count(*) FROM cell_centres) AS cells, probes,
        (SELECT {K} * f FROM cell_factor)::BIGINT AS shortlist,
        (SELECT {K} * f FROM cell_factor) / (SELECT count(*) FROM emb) AS compared,
        (SELECT count(*) FROM emb) AS points, round(recall, 6) AS recall, round((
          SELECT avg(n) FROM (SELECT q.query_id, count(*) AS n FROM probed q
            JOIN cell_sample s ON s.vec_id = q.query_id JOIN cells c ON c.cell = q.cell GROUP BY q.query_id))
          / (SELECT count(*) FROM emb), 6) AS read,
        round((SELECT count(*) FROM cell_found f JOIN truth t
               ON t.query_id = f.query_id AND t.vec_id = f.vec_id)
          / ((SELECT count(*) FROM emb) * {K}.0::DOUBLE), 6) AS recall_of_all FROM cell_probes""",
    "e3_run_benchmark_cells": f"""SELECT 'cells' AS mode, round((
          SELECT count(*) FROM cell_found f JOIN truth t
          ON t.query_id = f.query_id AND t.vec_id = f.vec_id)
        / ((SELECT count(*) FROM emb) * {K}.0::DOUBLE), 6) AS recall_at_10,
        (SELECT count(*) FROM emb) AS edges""",
    "e1_recall_at_k": "SELECT round(recall, 6) AS recall FROM recall_hash",
    "e2_recall_micro": f"""SELECT round((
          SELECT count(*) FROM found_hash f JOIN wide w
          ON w.query_id = f.query_id AND w.vec_id = f.vec_id)
        / (SELECT sum(least({K}, n)) FROM (
            SELECT w.query_id, count(*) AS n FROM wide w
            WHERE w.query_id IN (SELECT query_id FROM found_hash) GROUP BY w.query_id)), 6) AS recall""",
    "e3_evaluate_graph": """SELECT round(recall, 6) AS recall_at_10,
        (SELECT count(*) FROM hash_graph) AS edges FROM recall_hash""",
    "e3_run_benchmark": """SELECT 'hash' AS mode, round(recall, 6) AS recall_at_10,
        (SELECT count(*) FROM hash_graph) AS edges FROM recall_hash""",
    "e4_build_profile": """SELECT * FROM (
        SELECT leaf_count AS num_leaves, assignment_total AS partition_assignment_total,
          points_with_overlap AS partition_points_with_overlap, max_membership AS partition_max_membership,
          min_leaf_size AS partition_min_leaf_size, max_leaf_size AS partition_max_leaf_size,
          fallback_chunk_splits AS partition_fallback_chunk_splits,
          (SELECT 2 * count(*) FROM scored WHERE replica = 0 AND rank <= 12) AS candidate_edges
        FROM stats WHERE replica = 0) CROSS JOIN totals""",
    "e5_parameter_sweep": " UNION ALL ".join(
        f"""SELECT '{c.name}' AS name, '{c.mode}' AS mode,
            (SELECT round(recall, 6) FROM recall_s{i}) AS recall_at_10,
            (SELECT count(*) FROM {g} WHERE rank <= {c.max_degree}) AS edges"""
        for i, (c, g) in enumerate(
            zip(P.SWEEP, ("refined_k6_deg8", "refined_k12", "hash_k12", "refined_k12_finer", "hash_finer"))
        )
    ),
    "e6_rank_runs": """SELECT scale, name, row_number() OVER (PARTITION BY scale
        ORDER BY recall_at_10 DESC, qps DESC, build_sec, name)::INT AS position FROM runs""",
    "e7_recall_gate": """SELECT r.scale, r.name, r.recall_at_10 >= 0.7 AS passed, b.name AS first_passing
        FROM runs r LEFT JOIN (
          SELECT scale, name, row_number() OVER (PARTITION BY scale ORDER BY build_sec, name) AS rn
          FROM runs WHERE recall_at_10 >= 0.7) b ON b.scale = r.scale AND b.rn = 1""",
    "e8_recall_matched": """SELECT scale, name, partner, round(build_ratio, 6) AS build_ratio,
        round(qps_ratio, 6) AS qps_ratio FROM (
        SELECT a.scale, a.name, b.name AS partner, a.build_sec / b.build_sec AS build_ratio,
          b.qps / a.qps AS qps_ratio, row_number() OVER (PARTITION BY a.scale, a.name
            ORDER BY round(abs(a.recall_at_10 - b.recall_at_10), 12), b.build_sec, b.name) AS rn
        FROM runs a JOIN runs b ON b.scale = a.scale AND a.method = 'refined' AND b.method = 'hash')
        WHERE rn = 1""",
    "e9_config_delta": "SELECT r.scale, r.name, "
    + ", ".join(
        f"round(r.{m}::DOUBLE - b.{m}::DOUBLE, 6) AS {m}_delta, "
        f"round(100.0::DOUBLE * (r.{m}::DOUBLE - b.{m}::DOUBLE) / b.{m}, 6) AS {m}_pct"
        for m in ("build_sec", "recall_at_10", "qps", "edges")
    )
    + " FROM runs r JOIN runs b ON b.scale = r.scale AND b.name = 'refined_k12' WHERE r.name <> 'refined_k12'",
    "e10_reconcile_runs": """SELECT concat(name, '@', scale) AS name, unnest(CASE scale
          WHEN '1' THEN ['mode', 'build_sec', 'recall_at_10', 'qps', 'edges']
          WHEN '2' THEN ['mode'] WHEN '3' THEN ['build_sec'] WHEN '5' THEN ['edges']
          WHEN '6' THEN ['mode', 'build_sec', 'recall_at_10', 'qps', 'edges'] END) AS metric,
        CASE scale WHEN '1' THEN 'missing_result' WHEN '3' THEN 'missing_field'
          WHEN '6' THEN 'missing_manifest' ELSE 'mismatch' END AS status
        FROM runs WHERE scale IN ('1', '2', '3', '5', '6')""",
}
CTES["leafnn"] = """
    SELECT a.replica, a.leaf_id, a.vec_id AS src, b.vec_id AS dst, p.d, row_number() OVER (
      PARTITION BY a.replica, a.leaf_id, a.vec_id ORDER BY p.d, b.vec_id) AS rk
    FROM leaf a JOIN leaf b ON a.replica = b.replica AND a.leaf_id = b.leaf_id AND a.vec_id <> b.vec_id
    JOIN pd p ON p.src = a.vec_id AND p.dst = b.vec_id"""
CTES["numbered"] = """
    SELECT replica, leaf_id, vec_id, row_number() OVER (PARTITION BY replica, leaf_id ORDER BY vec_id) - 1 AS pos,
           count(*) OVER (PARTITION BY replica, leaf_id) AS m FROM leaf"""
CTES["wide"] = """
    SELECT src AS query_id, dst AS vec_id FROM (SELECT src, dst, row_number() OVER (
      PARTITION BY src ORDER BY d, dst) AS rank FROM pd) WHERE rank <= 30"""
ORACLE["s11_sweep_summary"] = ORACLE["e5_parameter_sweep"]
ORACLE["s3_read_fbin"] = ORACLE["s1_read_fvecs"]
ORACLE["s4_read_ibin"] = ORACLE["s2_read_ivecs"]
ORACLE["k1_exact_topk_blocked"] = ORACLE["k1_exact_topk_l2"]
ORACLE["q1_beam_search_repeated"] = ORACLE["q1_beam_search"]
ORACLE["q1_beam_search_short"] = ORACLE["q1_beam_search"].replace("found_hash", "found_short")
ORACLE |= {f"{name}_shuffled": ORACLE[name] for name in SHUFFLED}


def oracle() -> dict[str, str]:
    return {name: sql(body) for name, body in ORACLE.items()}
