"""SQL for the queries of this subpackage that SQL can express over whole tables."""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPAN = "list_slice(words, i, i + n - 1)"

DECONTAMINATE = rf"""
WITH word AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS re),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), (SELECT re FROM word)) AS words FROM benchmark),
sized AS (SELECT *, least(10, len(words)) AS n FROM item WHERE len(words) > 0),
win AS (SELECT DISTINCT item, n, array_to_string({_SPAN}, ' ') AS g FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM sized)),
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), (SELECT re FROM word)) AS words FROM documents),
run AS (SELECT doc_id, n, i, array_to_string({_SPAN}, ' ') AS g FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, i, run.n AS n, item FROM run JOIN win ON win.g = run.g AND win.n = run.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc.doc_id AS doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN who USING (doc_id)
"""

SUBSTRINGS = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 34), ' ')) AS g FROM (SELECT *, unnest(range(1, len(words) - 33)) AS i FROM doc)),
often AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN often USING (g)),
left_over AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.p) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM doc) w ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc.doc_id AS doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN left_over USING (doc_id)
"""

WARC = """
WITH page AS (SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
known AS (SELECT *, CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY sha1(payload)) END AS first FROM page)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM known
"""

_KEPT = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

BALL_TREE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {_KEPT}),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""


def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Each round: every part's nearest entry (b), then the floor of the means of an entry's parts (c); unused entries stay."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {_KEPT})""",
        f"""p AS MATERIALIZED (SELECT r, vec_id, part, e[len(e) // {parts} * part + 1 : len(e) // {parts} * (part + 1)] AS x FROM v, (SELECT unnest(range({parts})) AS part))""",
        f"""c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY entry < {entries})""",
    ]
    near = "(SELECT r, part, min({{'far': list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x), 'entry': entry}}) AS best FROM p JOIN c{0} c USING (part) GROUP BY r, part)"
    for i in range(rounds):
        steps += [
            f"b{i} AS MATERIALIZED {near.format(i)}",
            f"""m{i} AS MATERIALIZED (SELECT part, entry, list(mean ORDER BY place) AS x FROM (SELECT part, best.entry AS entry, place, floor(sum(x[place]) / count(*)) AS mean FROM b{i} JOIN p USING (r, part), (SELECT unnest(range(1, len(e) // {parts} + 1)) AS place FROM (SELECT e FROM v LIMIT 1)) GROUP BY ALL) GROUP BY part, entry)""",
            f"c{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (part, entry))",
        ]
    steps += [
        f"b AS MATERIALIZED {near.format(rounds)}",
        "code AS (SELECT r, string_agg(lower(lpad(to_hex(best.entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM b GROUP BY r)",
        f"book AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(x) AS y, unnest(range(len(x))) AS place FROM c{rounds}))",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM code JOIN v USING (r), book"


VECTOR_CODES = _vector_codes()
