"""The queries that SQL can express, as DuckDB SQL over the same tables.

Not here: both packings and language ID (a tokenizer, a trained model) and URL rules (mined
item sets); tests/llm compares them with plain versions.
"""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"
LINKED = """
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS id, b AS other FROM edges
          UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other),
parts AS (SELECT id, least(id, min(other)) AS component_id FROM reach GROUP BY id)"""


def _hex_number(text: str, digits: int = 13) -> str:
    return f"('0x' || substr(md5({text}), 1, {digits}))::BIGINT"


def _score(j: int) -> str:
    return f"(1.0::DOUBLE / -ln(({_hex_number(f'''k || ':shard{j}' ''')} + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE))"


OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4
         THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
           FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * c >= 85 * (x.n + y.n - c)), {LINKED}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN parts ON parts.id = d.doc_id"""

OP2 = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, chr(0)) AS k, coalesce(octet_length(encode(text)), 0) + 1 AS size,
         list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
         lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) AS c FROM documents, crc),
s AS (SELECT *, [{', '.join(_score(j) for j in range(9))}] AS s FROM d),
p AS (SELECT *, list_position(s, list_max(s[1:8])) - 1 AS shard, list_position(s, list_max(s)) - 1 AS grown_shard FROM s)
SELECT doc_id, size::BIGINT AS size, xor(c, 4294967295)::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k || ':slot'), 1, 3), k) - 1 AS slot,
       grown_shard::INT AS grown_shard FROM p"""

OP3 = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id
          WHERE list_cosine_similarity(x.e, y.e) >= 0.9), {LINKED},
n AS (SELECT a AS id, count(*) AS n FROM edges GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
       vec_id = coalesce(component_id, vec_id) AS kept
FROM v LEFT JOIN n ON n.id = vec_id LEFT JOIN parts ON parts.id = vec_id"""

OP4 = f"""
WITH l AS (SELECT doc_id, i, line, {_hex_number('line', 8)} AS h FROM (
         SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
b AS (SELECT *, coalesce((h + 31 * lag(h) OVER (PARTITION BY doc_id ORDER BY i)) % 3, 1) = 0 AS last FROM l),
k AS (SELECT *, coalesce(sum(last::INT) OVER (PARTITION BY doc_id ORDER BY i
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b),
c AS (SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) AS content, count(*) AS many,
         count(*) FILTER (WHERE regexp_matches(line, {WORDS})) AS filled FROM k GROUP BY 1, 2),
g AS (SELECT *, filled >= 2 AND row_number() OVER (PARTITION BY content ORDER BY doc_id, k) > 1 AS gone FROM c)
SELECT doc_id, sum(many)::INT AS n_lines, coalesce(sum(many) FILTER (WHERE gone), 0)::INT AS n_removed,
       sha256(coalesce(string_agg(content, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM g GROUP BY doc_id"""

OP4_RUNS = f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls, ls[i] AS line FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
f AS (SELECT doc_id, i, ls, row_number() OVER w AS k, lead(i) OVER w AS j FROM l
      WHERE regexp_matches(line, {WORDS}) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, k, i, j, array_to_string(ls[i:j], chr(10)) AS content FROM f WHERE j IS NOT NULL),
s AS (SELECT *, first_value(doc_id) OVER w AS doc, first_value(k) OVER w AS spot FROM p
      WINDOW w AS (PARTITION BY content ORDER BY doc_id, k)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i + (doc = doc_id AND spot = k - 1)::INT, j + 1)) AS i FROM s
         WHERE doc <> doc_id OR spot <> k),
g AS (SELECT l.doc_id, l.i, line, gone.i IS NOT NULL AS gone FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i)
SELECT doc_id, count(*)::INT AS n_lines, (count(*) FILTER (WHERE gone))::INT AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM g GROUP BY doc_id"""

OP5 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256 FROM d WINDOW g AS (PARTITION BY text_sha256)"""

OP7 = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS})) AS size,
                  md5(doc_id || ':mix') AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
c AS (SELECT *, [3.0, 1.0, 2.0][place % 3 + 1]::DOUBLE AS w, (2 * source_size)::DOUBLE AS cap,
             (sum(source_size) OVER () * 1.5)::DOUBLE AS goal FROM s),
l AS (SELECT *, (goal - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT *, least(cap, w * max(level) OVER ()) AS target, greatest(1, floor(goal / 100000))::BIGINT AS block FROM l),
seats AS (SELECT place, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, place, k) AS r, floor(goal / block) AS house
          FROM t, range(1, 200001) AS q(k) WHERE k <= target / block + 50 AND target > 0),
q AS (SELECT place, count(*) AS quota FROM seats WHERE r <= house GROUP BY 1),
p AS (SELECT t.*, least(coalesce(quota, 0) * block, 2 * source_size) AS total, greatest(source_size, 1) AS len,
             {_hex_number("place || ':mix'")} % ceil(greatest(source_size, 1) / block)::BIGINT * block AS start
      FROM t LEFT JOIN q USING (place)),
x AS (SELECT d.*, p.source_size, p.target, total // len AS rounds, total % len AS rest, start,
             sum(size) OVER (PARTITION BY place ORDER BY h, doc_id) - size AS pos
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (rounds * size + greatest(0, least(pos + size, start + rest) - greatest(pos, start))
        + greatest(0, least(pos + size, start + rest - source_size) - pos))::BIGINT AS taken FROM x"""

OP9 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM w, unnest(range(1, len(w) - 48)) AS u(i)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY md5(g)) AS least FROM v),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM f WHERE least < doc_id),
kept AS (SELECT w.doc_id, u.i, w.w[u.i] AS word FROM w, unnest(range(1, len(w) + 1)) AS u(i)),
k AS (SELECT kept.doc_id, string_agg(word, ' ' ORDER BY kept.i) AS t, count(*) AS n
      FROM kept ANTI JOIN gone ON gone.doc_id = kept.doc_id AND gone.i = kept.i GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""

def _more(label: str, cost: str, letter: str) -> str:
    """A label (seven digits of cost, then the audit) after one more edit."""
    return f"lpad((substr({label}, 1, 7)::INTEGER + {cost})::VARCHAR, 7, '0') || substr({label}, 8) || '{letter}'"


def _next_labels() -> str:
    """Labels of the four states after one turn ``x[1]``, and after the inserts behind it."""
    extra, live = "CASE WHEN x[1] BETWEEN 'A' AND 'Z' THEN 3 ELSE 0 END", "x[1] <> 'x'"

    def state(i: int, before: list[int], initial: str, rerole: bool) -> str:
        ways = [_more(f"l[{i}]", "4", "D")]
        for b in before:
            if rerole:
                ways.append(f"CASE WHEN {live} THEN {_more(f'l[{b}]', f'3 + {extra}', 'R')} END")
            ways.append(f"CASE WHEN lower(x[1]) = '{initial}' THEN {_more(f'l[{b}]', extra, 'K')} END")
        return f"least({', '.join(ways)})"

    turn = f"[{_more('l[1]', '4', 'D')}, {state(2, [1], 's', False)}, {state(3, [1, 2, 4], 'u', True)}, {state(4, [3], 'a', True)}]"
    return f"list_transform([{turn}], lambda n: {_INSERTS.replace('l[', 'n[')})[1]"


_AS_USER = f"least(l[3], {_more('l[1]', '3', 'I')}, {_more('l[2]', '3', 'I')}, {_more('l[4]', '3', 'I')})"
_INSERTS = f"list_transform([{_AS_USER}], lambda u: [l[1], l[2], u, least(l[4], {_more('u', '3', 'I')})])[1]"

#: The edit lattice by plain dynamic programming, one turn after the other.
OP12 = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
             lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT c.* EXCLUDE (k), xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
             list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
             lambda a, b: xor(t[(xor(a, b) % 256) + 1], a // 256))) % 20 AS draw FROM c, crc),
d AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
             CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM h, unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) WHERE draw <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
             regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM d),
f AS (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS ini,
             CASE WHEN body = '' THEN 'blank'
                  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                  WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM o),
g AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(ini) ELSE ini END AS letter,
             lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM f),
p AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
             list_reduce(list_prepend(['0000000', '9000000', '0000003I', '0000006II'], list(['' || letter] ORDER BY i)),
                         lambda l, x: {_next_labels()}) AS l FROM g GROUP BY conv_id),
b AS (SELECT * EXCLUDE (l), substr(least(l[1], l[4]), 1, 7)::BIGINT AS cost, substr(least(l[1], l[4]), 8) AS audit FROM p),
e AS (SELECT conv_id, j, audit[j] AS edit, sum((audit[j] <> 'I')::INTEGER) OVER (PARTITION BY conv_id ORDER BY j) AS i
      FROM b, unnest(range(1, length(audit) + 1)) AS u(j)),
m AS (SELECT e.conv_id, e.j, e.edit, g.role, g.text, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.j) AS place,
             (first_value(e.edit = 'K' AND g.ini = 's') OVER (PARTITION BY e.conv_id ORDER BY e.j))::INTEGER AS led
      FROM e LEFT JOIN g ON e.edit <> 'I' AND g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.i = e.i WHERE e.edit <> 'D'),
r AS (SELECT conv_id, string_agg((CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END)
             || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS lines FROM m GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id"""

OP13 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor, a.label = b.label AS same, b.vec_id AS id, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor, id, score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place
      FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.anchor, p.place, p.id AS positive, p.score AS goal, s.id, s.score,
             row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
      QUALIFY rank <= 3)
SELECT anchor AS anchor_id, positive AS positive_id, rank::INTEGER AS rank, id AS negative_id,
       goal AS positive_score, score AS negative_score FROM n"""

ORACLES = {
    "op1_ngram_jaccard_join": OP1,
    "op2_rendezvous_sharding": OP2,
    "op3_subspace_pigeonhole": OP3,
    "op4_line_chunks": OP4,
    "op4_line_runs": OP4_RUNS,
    "op5_exact_dedup": OP5,
    "op7_source_mixing": OP7,
    "op9_substring_dedup": OP9,
    "op12_edit_lattice_repair": OP12,
    "op13_residue_negatives": OP13,
}
