"""DuckDB SQL of the registered queries that SQL can express.

The others have no SQL form (rolling hashes, trained models, edit joins) or
none that is quick on whole tables (windows of 200 bytes); ``tests/llm``
compares them with brute force.
"""

from __future__ import annotations


def _apportion(name: str, table: str, group: str, key: str, votes: str, seats: str) -> str:
    """CTEs of Sainte-Laguë seats: ``name`` has the columns of ``table`` and ``won``."""
    over = f"OVER (PARTITION BY {group})" if group else "OVER ()"
    part = f"PARTITION BY {group}" if group else ""
    keys = f"{group}, {key}" if group else key
    using = f"USING ({keys})"
    return f"""
{name}_1 AS (
  SELECT *, sum({votes}) {over} AS all_votes, count(*) {over} AS n_rows,
         CASE WHEN sum({votes}) {over} > 0
              THEN CAST(floor(CAST({votes} AS DOUBLE) * {seats} / sum({votes}) {over} + 0.5) AS BIGINT)
              ELSE 0 END AS got
  FROM {table}),
{name}_2 AS (
  SELECT *, CASE WHEN all_votes > 0 THEN {seats} - sum(got) {over} ELSE 0 END AS open_seats FROM {name}_1),
{name}_3 AS (
  SELECT *, CASE WHEN all_votes > 0
                 THEN CAST(ceil(CAST((abs(open_seats) + n_rows) AS DOUBLE) * {votes} / all_votes) AS BIGINT) + 1
                 ELSE 0 END AS reach FROM {name}_2),
{name}_4 AS (
  SELECT {keys}, open_seats, {votes} AS v,
         unnest(CASE WHEN open_seats > 0 THEN range(CAST(got AS BIGINT), CAST(got + reach + 1 AS BIGINT))
                     WHEN open_seats < 0 THEN range(CAST(greatest(0, got - reach) AS BIGINT), CAST(got AS BIGINT))
                     ELSE range(0, 0) END) AS j
  FROM {name}_3),
{name}_5 AS (
  SELECT {keys}, open_seats, row_number() OVER ({part}
           ORDER BY -(CAST(v AS DOUBLE) / (2 * j + 1)) * sign(open_seats), {key} * sign(open_seats),
                    j * sign(open_seats)) AS place
  FROM {name}_4),
{name}_6 AS (
  SELECT {keys}, sum(sign(open_seats)) AS moved FROM {name}_5 WHERE place <= abs(open_seats) GROUP BY {keys}),
{name} AS (
  SELECT {name}_3.* EXCLUDE (all_votes, n_rows, got, open_seats, reach),
         CAST(got + coalesce(moved, 0) AS BIGINT) AS won
  FROM {name}_3 LEFT JOIN {name}_6 {using})"""


_DRAWN = "(({k}) + shift) * part // blocks - shift * part // blocks"


def _words(c: str) -> str:
    k = f"({c}) // block"
    before, after = _DRAWN.format(k=k), _DRAWN.format(k=k + " + 1")
    return f"(block * ({before}) + (({after}) - ({before})) * (({c}) % block))"


OP4 = rf"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM sums),
weighed AS (
  SELECT *, CASE sid % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         CAST(3 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM ranked),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(w) OVER ()
               - coalesce(sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            AS level FROM weighed),
chosen AS (SELECT level FROM levels WHERE level * w <= cap ORDER BY cap / w, sid LIMIT 1),
targets AS (
  SELECT source, source_size, sid, total, n_docs, least(cap, (SELECT level FROM chosen) * w) AS target,
         round(least(cap, (SELECT level FROM chosen) * w)) AS votes,
         greatest(1, CAST(ceil(total / 20000.0::DOUBLE) AS BIGINT)) AS block,
         CAST(ceil(n_docs / 5000.0::DOUBLE) AS BIGINT) AS shards FROM levels),
sought AS (SELECT *, CAST(round(total / CAST(block AS DOUBLE)) AS BIGINT) AS all_seats FROM targets),
{_apportion("plan", "sought", "", "sid", "votes", "all_seats")},
dealt AS (
  SELECT s.doc_id, s.source, s.size, p.sid, md5(concat_ws(':', '17', CAST(s.doc_id AS VARCHAR))) AS h, p.shards
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
placed AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % shards AS shard FROM dealt),
shard_sizes AS (SELECT sid, shard, CAST(sum(size) AS BIGINT) AS shard_size FROM placed GROUP BY sid, shard),
asked AS (
  SELECT z.*, p.won AS seats, p.block, p.source_size, p.target FROM shard_sizes z JOIN plan p USING (sid)),
{_apportion("quotas", "asked", "sid", "shard", "shard_size", "seats")},
cut AS (
  SELECT *, CAST(ceil(shard_size / CAST(block AS DOUBLE)) AS BIGINT) AS blocks FROM quotas),
drawn AS (
  SELECT *, coalesce(least(won, 3 * blocks) // nullif(blocks, 0), 0) AS whole,
         coalesce(least(won, 3 * blocks) % nullif(blocks, 0), 0) AS part,
         coalesce(CAST('0x' || substr(md5(concat_ws(':', '17', 'start', CAST(sid AS VARCHAR), CAST(shard AS VARCHAR))),
                                      1, 8) AS BIGINT) % nullif(blocks, 0), 0) AS shift FROM cut),
ends AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY sid, shard ORDER BY h, doc_id, size
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS top FROM placed)
SELECT e.doc_id, e.source, e.size, d.source_size, d.target,
       CASE WHEN size > 0 THEN CAST(whole * size + {_words("top")} - {_words("top - size")} AS BIGINT) ELSE 0 END AS taken
FROM ends e JOIN drawn d USING (sid, shard)
"""

OP1 = r"""
WITH turns AS (
  SELECT conv_id, role, text,
         '<|' || replace(coalesce(role, 'unknown'), '<|', '< |') || '|>' || chr(10)
         || replace(coalesce(text, ''), '<|', '< |') || chr(10) || '<|end|>' || chr(10) AS r,
         row_number() OVER (PARTITION BY conv_id
                            ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
digests AS (SELECT DISTINCT conv_id, md5(CAST(conv_id AS VARCHAR)) AS h FROM turns),
ends AS (
  SELECT conv_id, max(k) AS k, list(k ORDER BY k) AS ks,
         CAST('0x' || substr(any_value(h), 1, 15) AS BIGINT) AS deal, CAST('0x' || substr(any_value(h), 17, 8) AS BIGINT) AS pick
  FROM turns JOIN digests USING (conv_id) WHERE role = 'assistant' GROUP BY conv_id),
replies AS (
  SELECT t.conv_id, t.k, e.ks[1 + e.pick % len(e.ks)] AS leave,
         e.deal % greatest(1, (SELECT count(*) FROM ends) // 256) AS grp, t.text, t.r
  FROM turns t JOIN ends e USING (conv_id, k)),
paired AS (
  SELECT conv_id, k, leave, coalesce(lead(conv_id) OVER w, first_value(conv_id) OVER w) AS donor_id
  FROM replies WINDOW w AS (PARTITION BY grp ORDER BY conv_id)),
told AS (
  SELECT p.conv_id, p.donor_id, p.k, o.r AS other, l.text IS NOT DISTINCT FROM o.text AS same,
         CASE WHEN l.text IS NOT DISTINCT FROM o.text THEN p.leave ELSE p.leave - 1 END AS n
  FROM paired p JOIN replies o ON o.conv_id = p.donor_id JOIN turns l ON l.conv_id = p.conv_id AND l.k = p.leave
  WHERE p.donor_id <> p.conv_id),
prompts AS (
  SELECT d.conv_id, coalesce(string_agg(t.r, '' ORDER BY t.k), '') AS prompt
  FROM told d LEFT JOIN turns t ON t.conv_id = d.conv_id AND t.k <= d.n GROUP BY d.conv_id),
rests AS (
  SELECT d.conv_id, t.k, t.role, t.r,
         coalesce(sum(length(t.r)) OVER (PARTITION BY d.conv_id ORDER BY t.k
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM told d JOIN turns t ON t.conv_id = d.conv_id AND t.k > d.n AND t.k <= d.k),
chosen AS (
  SELECT conv_id, string_agg(r, '' ORDER BY k) AS chosen,
         string_agg(CAST(CAST(off + 14 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(off + length(r) - 1 AS BIGINT) AS VARCHAR),
                    ',' ORDER BY k) FILTER (WHERE role = 'assistant') AS chosen_mask
  FROM rests GROUP BY conv_id)
SELECT conv_id, donor_id, CAST(n AS INTEGER) AS n_prompt_turns, prompt, coalesce(chosen, '') AS chosen,
       CASE WHEN same THEN '' ELSE other END AS rejected, coalesce(chosen_mask, '') AS chosen_mask,
       CASE WHEN same THEN '' ELSE '14-' || CAST(length(other) - 1 AS VARCHAR) END AS rejected_mask,
       NOT same AS trainable
FROM told JOIN prompts USING (conv_id) LEFT JOIN chosen USING (conv_id)
"""

_RECORD = r"""'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
         || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13)
         || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10)
         || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"""

OP6 = rf"""
WITH records AS (
  SELECT page_id, {_RECORD} AS body,
         CASE WHEN page_id IS NULL THEN 'crawl-n' || substr(md5(coalesce(url, '')), 1, 3)
              ELSE 'crawl-' || CAST(CAST(floor(page_id / 256.0) AS BIGINT) AS VARCHAR) END AS file FROM pages),
hashed AS (SELECT page_id, file, CAST(strlen(body) AS BIGINT) AS length, sha256(body) AS digest FROM records),
mine AS (
  SELECT *, CAST(sum(length) OVER (PARTITION BY file ORDER BY page_id, digest
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - length AS start
  FROM hashed),
rot AS (
  SELECT page_id, url, CASE WHEN (page_id * 31 + 7) % 97 = 5 AND length(html) > 0
                            THEN chr(127) || substr(html, 2) ELSE html END AS html
  FROM pages WHERE coalesce((page_id * 31 + 7) % 97, 0) <> 11),
rot_records AS (SELECT page_id, {_RECORD} AS body FROM rot),
found AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS found_length, sha256(body) AS found_digest FROM rot_records)
SELECT m.file, m.start AS "offset", CASE WHEN f.found_digest IS NULL THEN 'missing' ELSE 'corrupt' END AS status,
       m.length, m.digest, f.found_length, f.found_digest
FROM mine m LEFT JOIN found f ON f.page_id IS NOT DISTINCT FROM m.page_id
WHERE f.found_digest IS DISTINCT FROM m.digest
"""

OP11 = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER same = 1 AS kept, sha256(norm) AS text_sha256
FROM texts
WINDOW same AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST)
"""

_VECTORS = """
  SELECT {columns}, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE))))"""

OP12 = f"""
WITH rows AS ({_VECTORS.format(columns="vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label")}
    AND label IS NOT NULL),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
found AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scores s USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 10
"""


def _lloyd(rounds: int) -> str:
    """CTEs ``near0`` .. ``near<rounds>`` and ``book0`` .. ``book<rounds>``."""
    out = ["book0 AS (SELECT rn - 1 AS entry, p, j, x AS c FROM cells WHERE rn <= 64)"]
    for i in range(rounds + 1):
        out.append(f"""near{i} AS (
  SELECT rn, p, entry, far FROM (
    SELECT rn, p, entry, sum((x - c) * (x - c)) AS far FROM cells JOIN book{i} USING (p, j) GROUP BY rn, p, entry)
  QUALIFY row_number() OVER (PARTITION BY rn, p ORDER BY far, entry) = 1)""")
        if i < rounds:
            out.append(f"""book{i + 1} AS (
  SELECT b.entry, b.p, b.j, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN (
    SELECT entry, p, j, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS c
    FROM cells JOIN near{i} USING (rn, p) GROUP BY entry, p, j) m USING (entry, p, j))""")
    return ",\n".join(out)


OP13 = f"""
WITH rows AS ({_VECTORS.format(columns="row_number() OVER (ORDER BY vec_id) AS rn, vec_id, label")}),
wide AS (SELECT max(len(v)) // 16 AS per FROM rows),
cells AS (
  SELECT rn, i // per AS p, i % per AS j, v[i + 1] AS x
  FROM (SELECT rn, v, per, unnest(range(len(v))) AS i FROM rows, wide)),
{_lloyd(2)},
codes AS (
  SELECT rn, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error
  FROM near2 GROUP BY rn),
books AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, entry, j)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM rows JOIN codes USING (rn), books
"""

ORACLE_SQL: dict[str, str] = {"op1_chat_format": OP1, "op4_mixing": OP4, "op6_warc_audit": OP6,
                              "op11_exact_dedup": OP11, "op12_hard_negatives": OP12, "op13_vector_codes": OP13}
