"""SQL over the same tables that states the results of the queries, written without looking at how Spark gets there."""

from __future__ import annotations

from cindermap.llm.licenses import KNOWN, SPELLINGS
from cindermap.llm.queries import DOMAINS, LEVELS, MAX_EPOCHS, SEED, SHARE_PERCENT, WEIGHTS

SQL: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _cases(level: str) -> str:
    whens = " ".join(f"WHEN '{name}' THEN {weight}" for name, weight in WEIGHTS[level].items())
    return f"CAST(CASE {level} {whens} ELSE 1 END AS HUGEINT)"


def _mixing() -> str:
    domains = " ".join(f"WHEN source IN ({', '.join(repr(s) for s in sources)}) THEN '{name}'" for name, sources in DOMAINS.items())
    parts = [
        f"counted AS (SELECT doc_id, CASE {domains} ELSE 'other' END AS domain, lang, source, len({_WORDS}) AS tokens FROM documents WHERE len({_WORDS}) > 0)",
        f"""tree0 AS (SELECT sum(tokens) * {MAX_EPOCHS} AS capacity, least(sum(tokens) * {MAX_EPOCHS}, CAST(floor(sum(tokens)::DECIMAL(30,0) * {SHARE_PERCENT} // 100) AS HUGEINT))::HUGEINT AS budget FROM counted)""",
    ]
    for depth, level in enumerate(LEVELS):
        above, path = LEVELS[:depth], LEVELS[: depth + 1]
        on = " AND ".join(f"p.{a} IS NOT DISTINCT FROM c.{a}" for a in above) or "true"
        side = f"PARTITION BY {', '.join(above) or '1'}"
        parts += [
            f"cap{depth} AS (SELECT {', '.join(path)}, sum(tokens)::HUGEINT * {MAX_EPOCHS} AS capacity, {_cases(level)} AS weight FROM counted GROUP BY {', '.join(path)})",
            f"in{depth} AS (SELECT c.*, p.budget FROM cap{depth} c JOIN tree{depth} p ON {on})",
            # the common level: a child is full if filling all children up to its ratio does not pass the budget
            f"""full{depth} AS (SELECT a.*, (SELECT sum(CASE WHEN b.capacity * a.weight <= a.capacity * b.weight THEN b.capacity * a.weight ELSE b.weight * a.capacity END)
                FROM in{depth} b WHERE {' AND '.join(f'a.{x} IS NOT DISTINCT FROM b.{x}' for x in above) or 'true'}) <= a.budget * a.weight AS filled FROM in{depth} a)""",
            f"""dealt{depth} AS (SELECT *, budget - coalesce(sum(capacity) FILTER (filled) OVER ({side}), 0) AS rest,
                coalesce(sum(weight) FILTER (NOT filled) OVER ({side}), 0) AS opened,
                coalesce(sum(weight) FILTER (NOT filled) OVER ({side} ORDER BY {level} NULLS FIRST), 0) AS upto FROM full{depth})""",
            f"""tree{depth + 1} AS (SELECT {', '.join(path)}, capacity, CAST(CASE WHEN filled THEN capacity ELSE (rest * upto) // opened - (rest * (upto - weight)) // opened END AS HUGEINT) AS budget FROM dealt{depth})""",
        ]
    on = " AND ".join(f"t.{x} IS NOT DISTINCT FROM c.{x}" for x in LEVELS)
    parts += [
        f"named AS (SELECT c.*, t.budget AS leaf_budget, t.budget // (t.capacity // {MAX_EPOCHS}) AS whole, t.budget % (t.capacity // {MAX_EPOCHS}) AS rest FROM counted c JOIN tree{len(LEVELS)} t ON {on})",
        f"""placed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY {', '.join(LEVELS)}
            ORDER BY md5(concat_ws(':', '{SEED}', whole, coalesce(CAST(doc_id AS VARCHAR), 'null'))), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM named)""",
    ]
    return f"""WITH {', '.join(parts)}
        SELECT doc_id, {', '.join(LEVELS)}, CAST(tokens AS BIGINT) AS tokens, CAST(leaf_budget AS BIGINT) AS leaf_budget,
            CAST(whole + CASE WHEN before < rest THEN 1 ELSE 0 END AS BIGINT) AS copies
        FROM placed WHERE whole + CASE WHEN before < rest THEN 1 ELSE 0 END > 0"""


SQL["op1_mixing"] = _mixing()

# crc32 by half bytes, low half first. The checksum's table for half bytes.
_CRC_TABLE = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
_CRC = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(regexp_replace(hex(encode(coalesce(text, ''))), '(.)(.)', '\\2\\1', 'g'), '.'),
    lambda h: CAST(instr('0123456789ABCDEF', h) - 1 AS BIGINT))), lambda c, h: xor(c >> 4, ({_CRC_TABLE}::BIGINT[])[xor(c & 15, h) + 1])))"""

SQL["op2_sharding"] = f"""
    WITH sized AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 8 AS BIGINT) AS size, {_CRC} AS text_crc32 FROM documents),
    summed AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM sized),
    placed AS (SELECT *, CAST(least(((2 * before + size) * 24) // (2 * total), 23) AS INTEGER) AS shard FROM summed)
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
        row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed"""

SQL["op3_ngram_jaccard"] = r"""
    WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM worded),
    tokens AS (SELECT doc_id, unnest(s) AS token FROM sets),
    sizes AS (SELECT doc_id, len(s) AS n FROM sets),
    overlap AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM overlap JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
    reach AS (SELECT a AS node, a AS other FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other)
    SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, coalesce(r.m, s.doc_id) AS component_id
    FROM sizes s LEFT JOIN (SELECT node, min(other) AS m FROM reach GROUP BY node) r ON r.node = s.doc_id"""


def _canonical(text: str) -> str:
    out = rf"regexp_replace(lower({text}), '(?m)^[ \t]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$', '', 'g')"
    for spelling, common in SPELLINGS:
        out = f"replace({out}, '{spelling}', '{common}')"
    return rf"regexp_replace({out}, '[!-/:-@\[-`{{-~«»“”‘’–—©\t\x0b\f\r ]+', ' ', 'g')"


def _joined(text: str) -> str:
    return rf"trim(regexp_replace({text}, '[ \n]+', ' ', 'g'))"


def _licenses() -> str:
    known = ", ".join(f"({_quote(name)}, {_quote(text)})" for name, text in KNOWN)
    return rf"""
    WITH known AS (SELECT DISTINCT name, {_joined(_canonical('body'))} AS form FROM (VALUES {known}) v(name, body)),
    canon AS (SELECT row_number() OVER () AS r, doc_id, {_canonical('text')} AS c FROM documents),
    blocks AS (
        SELECT r, 'l' || generate_subscripts(string_split(c, chr(10)), 1) AS b, unnest(string_split(c, chr(10))) AS block FROM canon
        UNION ALL SELECT r, 'p' || i, p FROM (SELECT r, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT r, regexp_split_to_array(c, '\n *(?:\n *)+') AS ps FROM canon))
            WHERE contains(trim(regexp_replace(p, '^[ \n]+|[ \n]+$', '', 'g')), chr(10))),
    held AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(DISTINCT b) AS n FROM blocks JOIN known ON {_joined('block')} = form GROUP BY r)
    SELECT doc_id, name AS whole_license, coalesce(licenses, '') AS licenses, coalesce(n, 0) AS n_blocks
    FROM canon LEFT JOIN (SELECT form, min(name) AS name FROM known GROUP BY form) k ON {_joined('c')} = form LEFT JOIN held USING (r)"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL["op5_license_scan"] = _licenses()

SQL["op7_line_dedup"] = r"""
    WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
    lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM split),
    full_lines AS (SELECT doc_id, pos, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM lines WHERE trim(line) <> ''),
    windows AS (SELECT a.doc_id, a.place, a.line || chr(10) || b.line || chr(10) || c.line AS w, [a.pos, b.pos, c.pos] AS ps FROM full_lines a
        JOIN full_lines b ON b.doc_id = a.doc_id AND b.place = a.place + 1 JOIN full_lines c ON c.doc_id = a.doc_id AND c.place = a.place + 2),
    firsts AS (SELECT w, min((doc_id, place)) AS f FROM windows GROUP BY w HAVING count(*) > 1),
    later AS (SELECT doc_id, CASE WHEN doc_id = f[1] AND place - f[2] < 3 THEN ps[4 - (place - f[2]):3] ELSE ps END AS ps FROM windows JOIN firsts USING (w) WHERE (doc_id, place) <> f),
    gone AS (SELECT DISTINCT doc_id, unnest(ps) AS pos FROM later),
    kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, length(CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END) AS n_chars
    FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id"""

SQL["op8_top_k"] = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""

SQL["op10_quality_rules"] = rf"""
    WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
    windows AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 1))) AS i, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS win FROM w),
    often AS (SELECT doc_id, win FROM windows GROUP BY ALL HAVING count(*) > 1),
    covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS place FROM windows SEMI JOIN often USING (doc_id, win)) GROUP BY doc_id),
    lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
    measured AS (SELECT w.doc_id, len(w) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words
        FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept
    FROM measured"""

SQL["op11_collocations"] = r"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
    worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    starts AS (SELECT lang, w[i:i + 4] AS w FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded)),
    counted AS (SELECT lang, m, array_to_string(w[1:m], ' ') AS phrase, count(*)::HUGEINT AS f FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS m FROM starts) GROUP BY ALL),
    langs AS (SELECT lang, sum(f) AS n FROM counted WHERE m = 1 GROUP BY lang),
    cand AS (SELECT lang, phrase, f AS a, m, string_split(phrase, ' ') AS w FROM counted WHERE m >= 2 AND f >= 100),
    cuts AS (SELECT lang, phrase, a, w, m, unnest(range(1, m)) AS k FROM cand),
    cutted AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n, (1000 * c.a * n) // (x.f * y.f) AS score FROM cuts c JOIN langs USING (lang)
        JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ') JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
    lowest AS (SELECT * FROM cutted QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    parts AS (SELECT lang, a AS longer, array_to_string(w[i:i + j - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM cand))),
    inside AS (SELECT DISTINCT p.lang, p.phrase FROM parts p JOIN cand c ON c.lang = p.lang AND c.phrase = p.phrase WHERE 100 * p.longer >= 100 * c.a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest ANTI JOIN inside USING (lang, phrase))
    SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
    FROM ranked WHERE rank <= 2000"""

_ID_CRC = _CRC.replace("coalesce(text, '')", "CAST(doc_id AS VARCHAR)")
SQL["op12_periodic_runs"] = rf"""
    WITH hashed AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w, {_ID_CRC} AS h FROM documents),
    cut AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM hashed),
    cycled AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS c FROM cut),
    words AS (SELECT r, doc_id, CAST(n AS BIGINT) AS n, CASE WHEN h % 10 = 0 THEN list_transform(range(0, n), lambda i: w[(CASE WHEN i < a THEN i ELSE a + (i - a) % c END) + 1]) ELSE w END AS w FROM cycled),
    windows AS (SELECT r, i, array_to_string(w[i + 1:i + 6], ' ') AS win FROM (SELECT r, w, unnest(range(0, n - 5)) AS i FROM words)),
    -- words that equal those q on: stretches of windows that do
    equal AS (SELECT x.r, y.i - x.i AS q, x.i FROM windows x JOIN windows y ON x.r = y.r AND x.win = y.win AND x.i < y.i),
    islands AS (SELECT r, q, min(i) AS s, max(i) + 6 - min(i) + q AS len FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS part FROM equal) GROUP BY r, q, part),
    runs AS (SELECT r, s, len, min(q) AS q FROM islands WHERE len >= greatest(12, 2 * q) GROUP BY r, s, len),
    listed AS (SELECT r, count(*) AS n_runs, string_agg(concat(s, ',', len, ',', q, chr(10)), '' ORDER BY s, q) AS lines, arg_min((s, len, q), (-len, s, q)) AS best FROM runs GROUP BY r),
    gone AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM runs),
    kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM (SELECT r, unnest(range(0, n)) AS i, unnest(w) AS word FROM words) ANTI JOIN gone USING (r, i) GROUP BY r)
    SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best[1] AS BIGINT) AS start, CAST(best[2] AS BIGINT) AS length, CAST(best[3] AS BIGINT) AS period,
        CAST((1000 * best[2]) // best[3] AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
    FROM words LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)"""

SQL["op13_near_vectors"] = """
    WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    fit AS (SELECT r, vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS (SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM fit a JOIN fit b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
    reach AS (SELECT a AS node, b AS other FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other),
    least AS (SELECT node, min(vec_id) AS m FROM reach JOIN v ON v.r = reach.other GROUP BY node)
    SELECT vec_id, coalesce(n, 0) AS n_links, least(m, vec_id) AS component_id, vec_id IS NOT DISTINCT FROM least(m, vec_id) AS kept
    FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = v.r LEFT JOIN least ON node = v.r"""
