"""The llm queries that SQL can express, for DuckDB."""

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLE: dict[str, str] = {}

ORACLE["op2_warc"] = """
WITH h AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM h WHERE payload_bytes >= 100
  GROUP BY payload_digest
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END
         AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM h LEFT JOIN f USING (payload_digest)
"""

ORACLE["op4_range_graph"] = """
WITH RECURSIVE links AS (
  SELECT a.vec_id AS src, b.vec_id AS dst
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.95
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT reach.vec_id, links.dst FROM reach JOIN links ON links.src = reach.other
), comp AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), n AS (
  SELECT src, count(*) AS n_links FROM links GROUP BY src
)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept
FROM comp c LEFT JOIN n ON n.src = c.vec_id
"""

# The share per weight is that of the first source, by size and weight, that it does not fill.
ORACLE["op5_mixing"] = f"""
WITH d AS (
  SELECT doc_id, source, CAST({_WORDS} AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, sum(3 * source_size) OVER o AS caps_before,
         sum(weight) OVER (ORDER BY source_size / weight, source
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left,
         sum(source_size) OVER () AS total
  FROM s WINDOW o AS (ORDER BY source_size / weight, source
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), share AS (
  SELECT arg_min((total - coalesce(caps_before, 0))::DOUBLE / weights_left::DOUBLE,
                 struct_pack(a := source_size / weight, b := source)) AS per_weight
  FROM r
  WHERE (total - coalesce(caps_before, 0))::DOUBLE / weights_left::DOUBLE * weight < 3 * source_size
), t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, coalesce(per_weight, 0) * weight) AS target
  FROM s, share
), m AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT
           / 4294967296.0 AS draw
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT)
         AS taken
FROM m
"""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op11_phrases"] = f"""
WITH w AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array({_LOWER.format("text")}, '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents)
), f AS MATERIALIZED (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2),
             lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
    FROM w, (SELECT unnest([1, 2, 3]) AS size))
  GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), cand AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r,
         (1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c
  JOIN f l ON l.lang = c.lang AND l.size = k AND l.phrase = array_to_string(ws[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.size = c.size - k AND r.phrase = array_to_string(ws[k + 1:], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, part, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS part
    FROM cand WHERE size = 3) GROUP BY lang, part
)
SELECT * FROM (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank,
         phrase, a, l, r, n, score
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.part = b.phrase
  JOIN totals t ON t.lang = b.lang
  WHERE longer IS NULL OR 100 * longer < 50 * a)
WHERE rank <= 2000
"""


def _field(value: str) -> str:
    text = f"({value})::VARCHAR"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_RUNS = """list_transform(range(0, (len(nodes) + 7) // 8),
    lambda i: sha256(array_to_string(nodes[8 * i + 1:8 * i + 8], '')))"""
_SIBLINGS = """
    array_to_string(nodes[(pos >> (3 * step)) // 8 * 8 + 1:pos >> (3 * step)], '') AS l,
    array_to_string(nodes[(pos >> (3 * step)) + 2:(pos >> (3 * step)) // 8 * 8 + 8], '') AS r"""
_CRC = """xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda crc, byte: list_reduce(list_transform(range(8), lambda i: i::BIGINT), lambda x, i:
      CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, byte)),
    4294967295::BIGINT), 4294967295::BIGINT)"""

ORACLE["op13_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf("text")} AS leaf,
         CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(_LOWER.replace("coalesce({}, '')", "text"))} ELSE {_leaf("text")} END AS shown,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos
  FROM documents
), low AS (
  SELECT lang, 0 AS step, list(leaf ORDER BY doc_id) AS nodes FROM d GROUP BY lang
  UNION ALL SELECT lang, step + 1, {_RUNS} FROM low WHERE len(nodes) > 1
), subs AS (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos
  FROM low WHERE len(nodes) = 1
), high AS (
  SELECT 0 AS step, list(subroot ORDER BY pos) AS nodes FROM subs
  UNION ALL SELECT step + 1, {_RUNS} FROM high WHERE len(nodes) > 1
), steps AS (
  SELECT d.doc_id, low.step, {_SIBLINGS} FROM d JOIN low ON low.lang IS NOT DISTINCT FROM d.lang
  WHERE len(nodes) > 1
  UNION ALL SELECT d.doc_id, 100 + high.step, {_SIBLINGS.replace("(pos >>", "(subs.pos >>").replace(":pos >>", ":subs.pos >>")}
  FROM d JOIN subs ON subs.lang IS NOT DISTINCT FROM d.lang, high WHERE len(nodes) > 1
), proofs AS (
  SELECT doc_id, list({{'l': l, 'r': r}} ORDER BY step) AS proof FROM steps GROUP BY doc_id
), folded AS (
  SELECT d.doc_id, leaf, subroot, (SELECT nodes[1] FROM high WHERE len(nodes) = 1) AS root,
         sha256(array_to_string(list_transform(proof, lambda s: s.l || s.r), '')) AS proof_sha256,
         list_reduce(proof, lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}, {{'l': shown, 'r': ''}}).l
           AS folded_root
  FROM d JOIN subs ON subs.lang IS NOT DISTINCT FROM d.lang JOIN proofs ON proofs.doc_id = d.doc_id
)
SELECT *, folded_root = root AS verified FROM folded
"""
