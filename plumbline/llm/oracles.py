"""The same results in plain SQL of another engine, for the operations that SQL expresses."""

from __future__ import annotations

from plumbline.llm.chat_template import BOS, CONTROLS, END, EOS, SEP, START
from plumbline.llm.mixing import BLOCK, PRIME, REPEATS, ROUNDS, SEED, SLOTS, WEIGHTS

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def near_duplicates(width: int = 2, percent: int = 80) -> str:
    """All pairs by a join on shingles, components by recursion."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {width} THEN list_transform(range(1, len(w) - {width - 2}), lambda i: {gram}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
    both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a),
    c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def line_templates(depth: int = 3, least: int = 10, share: float = 0.7, shortest: int = 1, long: int = 10, twice: int = 2) -> str:
    """Templates by their words, without hashes; lines without a template and long lines by all their words."""
    return f"""WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
    r AS (SELECT doc_id, text, pos, regexp_extract_all(line, '{WORD}') AS r FROM l),
    m AS (SELECT *, array_to_string(r, ' ') AS whole, CASE WHEN len(r) >= {depth} THEN list_transform(r, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) ELSE r END AS w FROM r WHERE len(r) >= {shortest}),
    c AS (SELECT *, len(w)::VARCHAR || ' ' || array_to_string(w[1:{depth}], ' ') AS leaf FROM m),
    busy AS (SELECT leaf FROM c GROUP BY leaf HAVING count(DISTINCT text) >= {least}),
    h AS (SELECT c.* FROM c JOIN busy USING (leaf)),
    k AS (SELECT leaf, w, count(DISTINCT text) AS c FROM h GROUP BY 1, 2),
    p AS (SELECT leaf, w, c, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM k),
    s AS (SELECT leaf, place, word, true AS fixed FROM p WHERE place > {depth} GROUP BY 1, 2, 3 HAVING sum(c) >= {least}),
    shape AS (SELECT p.leaf, p.w, string_agg(CASE WHEN s.fixed THEN p.word ELSE '<*>' END, ' ' ORDER BY p.place) AS shape, count(*) FILTER (WHERE s.fixed AND p.word <> '<*>') AS fixed, bool_and(p.word = '<*>') AS all_fields
        FROM p LEFT JOIN s ON s.leaf = p.leaf AND s.place = p.place AND s.word = p.word WHERE p.place > {depth} GROUP BY 1, 2),
    t AS (SELECT leaf, w, 's ' || leaf || ' ' || shape AS template FROM shape WHERE fixed + len(list_filter(w[1:{depth}], lambda x: x <> '<*>')) >= {share}::DOUBLE * len(w) AND (fixed > 0 OR all_fields)),
    f AS (SELECT h.doc_id, h.text, h.pos, coalesce(t.template, 'm ' || h.whole) AS template FROM h LEFT JOIN t ON t.leaf = h.leaf AND t.w = h.w),
    again AS (SELECT template, min(doc_id) AS first FROM f GROUP BY template HAVING count(DISTINCT text) >= {least}),
    copied AS (SELECT whole, min(doc_id) AS first FROM m WHERE len(r) >= {long} GROUP BY whole HAVING count(DISTINCT text) >= {twice}),
    gone AS (SELECT f.doc_id, f.text, f.pos FROM f JOIN again USING (template) WHERE f.doc_id <> again.first
        UNION SELECT m.doc_id, m.text, m.pos FROM m JOIN copied USING (whole) WHERE m.doc_id <> copied.first),
    kept AS (SELECT l.doc_id, l.text, count(*) AS n_lines, count(gone.pos) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL), '') AS left_
        FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.text = l.text AND gone.pos = l.pos GROUP BY 1, 2)
    SELECT d.doc_id, coalesce(kept.n_lines, 0) AS n_lines, coalesce(kept.n_dropped, 0) AS n_dropped, sha256(coalesce(kept.left_, '')) AS kept_sha256 FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id AND kept.text = d.text"""


def repeated_spans(length: int = 400) -> str:
    """Every string of ``length`` bytes as hexadecimal digits, by its start; bytes covered by one that starts twice go."""
    return f"""WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    s AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, {2 * length})) AS g FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - {length - 1})) AS i FROM h WHERE len(x) >= {2 * length})),
    c AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
    e AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM s JOIN c USING (g)),
    r AS (SELECT doc_id, min(i) AS a, max(i) + {length} AS b FROM e GROUP BY doc_id, island),
    o AS (SELECT *, coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM r),
    z AS (SELECT doc_id, a, b, sum((a > before)::INT) OVER (PARTITION BY doc_id ORDER BY a) AS span FROM o),
    m AS (SELECT doc_id, span, min(a) AS a, max(b) AS b FROM z GROUP BY 1, 2),
    n AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM m),
    k AS (SELECT n.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS head, max(b) AS tail FROM n JOIN h USING (doc_id) GROUP BY n.doc_id)
    SELECT h.doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256 FROM h LEFT JOIN k USING (doc_id)"""


def _scatter(x: str) -> str:
    one = f"((({x}) % {PRIME}) * 48271 + 11) % {PRIME}"
    return f"(((({one}) * ({one}) + 69621) % {PRIME}) * 16807 + ({one}) + 7) % {PRIME}"


def mix_sources(share: float = 1.5) -> str:
    """Targets by water filling, one number per slot, the shuffle unrolled round by round."""
    rounds = "SELECT rank, n, pass, j % n AS x FROM slots WHERE pass < " + str(REPEATS)
    for r in range(ROUNDS):
        key = f"rank * 1000003 + pass * 10007 + {SEED} + {r} * 7919"
        rounds = f"SELECT rank, n, pass, CASE WHEN (({_scatter(f'm + rank * 331 + pass * 17 + {r} * 60013 + {SEED}')}) // 8192) % 2 = 1 THEN y ELSE x END AS x FROM (SELECT *, greatest(x, y) AS m FROM (SELECT *, ((({_scatter(key)}) % n) + n - x) % n AS y FROM ({rounds})))"
    return f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, {_scatter('coalesce(doc_id, 0) % 1000000007 + 1000000007')} AS u FROM documents),
    r AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
    w AS (SELECT *, {list(WEIGHTS)}[rank % {len(WEIGHTS)} + 1] AS weight, ss * {REPEATS} AS cap FROM r),
    v AS (SELECT *, (sum(ss) OVER () * {share}::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight::DOUBLE, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
    t AS (SELECT *, least(cap::DOUBLE, weight * max(level) OVER ()) AS target, (ss + {BLOCK - 1}) // {BLOCK} AS n FROM v),
    g AS (SELECT rank, n, target / {BLOCK} / (sum(target) OVER () / {BLOCK}) AS p, sum(target) OVER () / {BLOCK} AS total, floor(sum(target) OVER () / {BLOCK} / {SLOTS})::BIGINT AS whole FROM t WHERE target > 0),
    s AS (SELECT *, unnest(range(whole + 1)) AS shard FROM g),
    k AS (SELECT *, (CASE WHEN shard < whole THEN {SLOTS} ELSE greatest(round(total - whole * {SLOTS}), (whole = 0)::INT) END)::BIGINT AS k FROM s),
    b AS (SELECT *, floor(k * p)::BIGINT AS base, k * p - floor(k * p) AS part FROM k),
    h AS (SELECT *, (k - sum(base) OVER (PARTITION BY shard))::BIGINT AS draws, sum(part) OVER (PARTITION BY shard ORDER BY rank) AS hi, sum(part) OVER (PARTITION BY shard) AS all_, max(rank) OVER (PARTITION BY shard) AS last FROM b),
    q AS (SELECT shard, all_, ({_scatter('(' + _scatter(f'shard * 7919 + {SEED}') + ') + i * 104729')})::DOUBLE / {PRIME} * all_ AS v FROM (SELECT shard, all_, unnest(range(draws)) AS i FROM (SELECT DISTINCT shard, all_, draws FROM h))),
    c AS (SELECT h.rank, h.n, h.shard, h.base + (SELECT count(*) FROM q WHERE q.shard = h.shard AND v >= h.hi - h.part AND (v < h.hi OR h.rank = h.last)) AS cnt FROM h),
    f AS (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY rank ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM c),
    slots AS (SELECT rank, n, j, j // n AS pass FROM (SELECT rank, n, unnest(range(first, first + cnt)) AS j FROM f)),
    read_ AS (SELECT rank, x AS block, count(*) AS times FROM ({rounds}) GROUP BY 1, 2),
    packed AS (SELECT d.doc_id, d.size, t.ss, t.target, t.rank, sum(size) OVER (PARTITION BY t.rank ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
    pieces AS (SELECT *, unnest(range((start // {BLOCK})::BIGINT, ((start + size - 1) // {BLOCK} + 1)::BIGINT)) AS block FROM packed WHERE size > 0),
    taken AS (SELECT p.rank, p.start, sum(times * (least(p.start + p.size, (p.block + 1) * {BLOCK}) - greatest(p.start, p.block * {BLOCK})))::BIGINT AS taken FROM pieces p JOIN read_ ON read_.rank = p.rank AND read_.block = p.block GROUP BY 1, 2)
    SELECT packed.doc_id, packed.size, packed.ss AS source_size, packed.target, CASE WHEN packed.size > 0 THEN coalesce(taken.taken, 0) ELSE 0 END AS taken FROM packed LEFT JOIN taken ON taken.rank = packed.rank AND taken.start = packed.start"""


def crc32(text: str) -> str:
    """Unsigned crc32 of a text of ASCII signs, byte by byte and bit by bit."""
    byte = "list_reduce(list_concat([xor(a, b)], range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda s: ord(s)::BIGINT)), lambda a, b: {byte}))"


def merkle_manifest(fanout: int = 16) -> str:
    """Levels by recursion over all groups, proofs by joining each leaf with the nodes of its run at every level, folding by recursion."""
    f = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(f(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    fold = f"SELECT g, lvl + 1, pos // {fanout}, (n + {fanout - 1}) // {fanout}, sha256(string_agg(h, '' ORDER BY pos)) FROM {{}} WHERE n > 1 GROUP BY g, lvl, pos // {fanout}, n"
    sib = lambda t, sign: f"coalesce((SELECT string_agg(s.h, '' ORDER BY s.pos) FROM {t} s WHERE s.g = x.g AND s.lvl = x.lvl AND s.pos // {fanout} = x.pos // {fanout} AND s.pos {sign} x.pos), '')"
    return f"""WITH RECURSIVE l AS (SELECT doc_id, coalesce('1' || source, '0') AS g, {leaf('text')} AS h, CASE WHEN {crc32('doc_id::VARCHAR')} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS bad FROM documents),
    p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM l),
    t AS (SELECT g, 0 AS lvl, pos, n, h FROM p UNION ALL {fold.format('t')}),
    subs AS (SELECT g AS own, h FROM t WHERE n = 1),
    u AS (SELECT '' AS g, 0 AS lvl, row_number() OVER (ORDER BY own) - 1 AS pos, count(*) OVER () AS n, h FROM subs UNION ALL {fold.format('u')}),
    pu AS (SELECT own, row_number() OVER (ORDER BY own) - 1 AS pos FROM subs),
    path AS (SELECT x.g, x.lvl, x.pos, {sib('t', '<')} AS a, {sib('t', '>')} AS b FROM t x WHERE n > 1),
    upath AS (SELECT x.lvl, x.pos, {sib('u', '<')} AS a, {sib('u', '>')} AS b FROM u x WHERE n > 1),
    steps AS (SELECT p.g, p.pos AS leaf_at, path.lvl, a, b FROM p JOIN path ON path.g = p.g AND path.pos = p.pos // ({fanout} ** path.lvl)::BIGINT
        UNION ALL SELECT p.g, p.pos, 1000 + upath.lvl, a, b FROM p JOIN pu ON pu.own = p.g JOIN upath ON upath.pos = pu.pos // ({fanout} ** upath.lvl)::BIGINT),
    whole AS (SELECT g, leaf_at, list(a ORDER BY lvl) AS a, list(b ORDER BY lvl) AS b FROM steps GROUP BY 1, 2),
    w AS (SELECT p.*, coalesce(a, []) AS a, coalesce(b, []) AS b FROM p LEFT JOIN whole ON whole.g = p.g AND leaf_at = p.pos),
    f AS (SELECT g, pos, 1 AS i, coalesce(bad, h) AS v FROM w UNION ALL SELECT f.g, f.pos, i + 1, sha256(w.a[i] || v || w.b[i]) FROM f JOIN w ON w.g = f.g AND w.pos = f.pos WHERE i <= len(w.a)),
    e AS (SELECT f.g, f.pos, v FROM f JOIN w ON w.g = f.g AND w.pos = f.pos WHERE i = len(w.a) + 1)
    SELECT w.doc_id, w.h AS leaf, subs.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(array_to_string(list_transform(range(1, len(a) + 1), lambda i: a[i] || b[i]), '')) AS proof_sha256, e.v AS folded_root, e.v = (SELECT h FROM u WHERE n = 1) AS verified
    FROM w JOIN subs ON subs.own = w.g JOIN e ON e.g = w.g AND e.pos = w.pos"""


def conversation_repair() -> str:
    """Whole conversations row by row, with what is repaired so far beside each state; no pieces."""
    return f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f FROM conversations),
    d AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE f WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE f <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy) AS k, left(role, 1) AS i FROM d),
    s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS seen, lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS prior FROM o),
    r AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN seen THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END AS fault FROM s),
    ins(p, q, e, made, c) AS (VALUES (0, 0, '', []::VARCHAR[], 0), (1, 1, '', [], 0), (2, 2, '', [], 0), (3, 3, '', [], 0), (0, 2, 'I', ['user:'], 5), (1, 2, 'I', ['user:'], 5), (3, 2, 'I', ['user:'], 5), (2, 3, 'I', ['assistant:'], 5)),
    t AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, 0 AS state, {{'cost': 0, 'audit': '', 'out': []::VARCHAR[]}} AS b FROM conversations UNION ALL
        SELECT conv_id, k, state, min({{'cost': cost, 'audit': audit, 'out': "out"}}) FROM (
            SELECT t.conv_id, r.k, x.state, b.cost + ins.c + x.cost AS cost, b.audit || e || x.edit AS audit, b."out" || made || x.line AS "out" FROM t JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.k = t.k + 1 JOIN ins ON ins.p = t.state,
            LATERAL (SELECT ins.q AS state, 2 AS cost, 'D' AS edit, []::VARCHAR[] AS line
                UNION ALL SELECT CASE r.i WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, CASE r.fault WHEN 't' THEN 5 ELSE 0 END, 'K', [r.role || ':' || r.text] WHERE r.fault NOT IN ('b', 'd') AND ((r.i = 's' AND ins.q = 0) OR (r.i = 'u' AND ins.q <> 2) OR (r.i = 'a' AND ins.q = 2))
                UNION ALL SELECT CASE ins.q WHEN 2 THEN 3 ELSE 2 END, CASE r.fault WHEN 't' THEN 6 ELSE 1 END, 'R', [CASE ins.q WHEN 2 THEN 'assistant:' ELSE 'user:' END || r.text] WHERE r.fault NOT IN ('b', 'd')) x) GROUP BY conv_id, k, state),
    n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (k > 1 AND prior || i NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
    z AS (SELECT t.conv_id, min({{'cost': b.cost + CASE state WHEN 2 THEN 5 ELSE 0 END, 'audit': b.audit || CASE state WHEN 2 THEN 'I' ELSE '' END, 'out': b."out" || CASE state WHEN 2 THEN ['assistant:'] ELSE [] END}}) AS b
        FROM t LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM t.conv_id WHERE t.k = coalesce(n.n, 0) AND state <> 1 GROUP BY t.conv_id)
    SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, b.cost::BIGINT AS cost, b.audit AS audit, sha256(array_to_string(b."out", chr(10))) AS repaired_sha256
    FROM z LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM z.conv_id"""


def chat_format() -> str:
    """Turns and learned texts from the table itself; the formatted length from what escaping adds: a sign for each backslash and each control string."""
    some = lambda t, c: f"(length({t}) - length(replace({t}, '{c}', ''))) // {len(c)}"
    size = lambda t: f"length({t}) + {' + '.join(some(t, c) for c in (chr(92), *CONTROLS))}"
    return f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, ({len(BOS) + len(EOS)} + sum({len(START + SEP + END)} + {size('role')} + {size('text')}))::BIGINT AS formatted_chars FROM r GROUP BY conv_id"""
