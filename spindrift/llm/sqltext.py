"""SQL counterparts of page frames, spam pages, near-duplicates and reading levels; DuckDB dialect, written for its regular expressions."""

from __future__ import annotations

from spindrift.llm import boilerplate as b
from spindrift.llm import spam
from spindrift.llm.difficulty import TOLERANCE
from spindrift.llm.words import CLOSED
from spindrift.plans.sqltext import SQL_PAGES, sql_domain


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_TOKEN = r"[\p{L}\p{N}]+"
_STOPS = "[" + ", ".join(_quoted(w) for w in sorted({w for ws in CLOSED.values() for w in ws})) + "]"
_TRIM = _quoted(b._SPACES)
_PIECE_CUT = r"regexp_replace(regexp_replace(regexp_replace(m, '^[^:]{1,20}: ', ''), '([\p{Ll})])(\p{Lu})', '\1' || chr(1) || '\2', 'g'), '\s*[|·•>»/,–]\s*|\s{2,}|\t', chr(1), 'g')"
_MARKED = r"^.+[^\p{L}\p{N}]$"
_WORDS = lambda k: f"array_to_string(string_split(m, ' ')[:{k}], ' ')"
#: Common tables up to ``labelled(id, labels)`` and ``own(id, site, page)``: marks, the learned lexicon, both passes.
_FRAME = f"""own AS MATERIALIZED (SELECT id, nullif({sql_domain('url')}, '') AS site, page FROM {SQL_PAGES}),
    split AS (SELECT id, site, generate_subscripts(ls, 1) AS place, trim(unnest(ls), {_TRIM}) AS x, nullif(regexp_extract(site, '^([^.]{{3,}})', 1), '') AS name FROM (SELECT id, site, string_split(page, chr(10)) AS ls FROM own WHERE page IS NOT NULL)),
    named AS (SELECT id, site, place, x, CASE WHEN name IS NULL THEN x ELSE replace(replace(x, upper(name[1]) || name[2:], '§'), name, '§') END AS m FROM split),
    masked AS (SELECT id, site, place, x, CASE WHEN length(x) <= {b.FOLDED} THEN regexp_replace(m, '[0-9]+', '0', 'g') ELSE m END AS m,
        length(x) - length(replace(x, ' ', '')) + 1 AS n, len(list_filter(regexp_extract_all(lower(x), '{_TOKEN}'), lambda w: list_contains({_STOPS}, w))) AS s FROM named),
    lined AS MATERIALIZED (SELECT *, (n >= {b.SENTENCE_WORDS} AND length(x) >= {2 * b.SENTENCE_WORDS} AND s >= {b.STOP_DENSITY} * n) OR (length(x) >= {b.CLOSED_LENGTH} AND x[-1] IN ({', '.join(map(_quoted, b._ENDING))})) AS sentence FROM masked),
    pieces AS (SELECT *, CASE WHEN sentence OR x = '' THEN NULL ELSE list_filter(string_split({_PIECE_CUT}, chr(1)), lambda p: p <> '') END AS ps FROM lined),
    marks AS MATERIALIZED (SELECT id, site, place, {b.LINE} AS kind, m AS mark, 0 AS size FROM lined WHERE x <> ''
        UNION ALL SELECT id, site, place, {b.LONG_OPENING}, regexp_replace({_WORDS(4)}, '[0-9]+', '0', 'g'), 0 FROM lined WHERE x <> '' AND n > 5
        UNION ALL SELECT id, site, place, {b.OPENING}, regexp_replace(m[:strpos(m, ':')], '[0-9]+', '0', 'g'), 0 FROM lined WHERE strpos(m, ':') BETWEEN 2 AND {b.LABEL} AND strpos(m, ':') < length(m)
        UNION ALL SELECT id, site, place, {b.OPENING}, {_WORDS(2)}, 0 FROM lined WHERE NOT sentence AND n > 2
        UNION ALL SELECT id, site, place, {b.OPENING}, {_WORDS(1)} || ' ', 0 FROM lined WHERE NOT sentence AND n > 1 AND regexp_matches({_WORDS(1)}, {_quoted(_MARKED)})
        UNION ALL SELECT id, site, place, {b.PIECES}, p, length(p) FROM (SELECT id, site, place, unnest(ps) AS p FROM pieces WHERE len(ps) > 1 OR length(m) <= {b.PIECE}) WHERE length(p) <= {b.PIECE}),
    sized AS (SELECT site, count(*) AS pages FROM own WHERE page IS NOT NULL AND site IS NOT NULL GROUP BY site),
    counted AS (SELECT kind, mark, count(DISTINCT id) AS k, any_value(pages) AS pages FROM marks JOIN sized USING (site) GROUP BY kind, mark, site),
    asked AS (SELECT *, greatest({b.PART_LEAST}, CASE WHEN kind IN ({b.OPENING}, {b.LONG_OPENING}) THEN usual ELSE least(usual, {b.ANYWAY}) END) AS part FROM (SELECT *, {b.LIFT} * sum(k) OVER (PARTITION BY kind, mark) / (SELECT sum(pages) FROM sized)::DOUBLE AS usual FROM counted)),
    lexicon AS MATERIALIZED (SELECT kind, mark, share FROM (SELECT kind, mark, coalesce(sum(k) FILTER (pages >= {b.SITE_LEAST} AND k >= {b.PAGES_LEAST} AND floor((20 * k)::DOUBLE / pages) / 20 >= part - 1e-9), 0)::DOUBLE / sum(k) FILTER (pages >= {b.SITE_LEAST}) AS share
        FROM asked GROUP BY kind, mark) WHERE share >= {b.SOME}),
    found AS (SELECT id, place, max(share) FILTER (kind = {b.LINE}) AS line, max(share) FILTER (kind = {b.OPENING}) AS opening, max(share) FILTER (kind = {b.LONG_OPENING}) AS long, sum(size) FILTER (kind = {b.PIECES} AND share >= {b.SURE}) AS dense FROM marks JOIN lexicon USING (kind, mark) GROUP BY id, place),
    judged AS (SELECT id, place, x, sentence OR contains(x, '://') AS plain, coalesce(line, 0) AS line, coalesce(opening, 0) AS opening, coalesce(long, 0) AS long, coalesce(dense, 0) / greatest(1, coalesce(list_sum(list_transform(ps, lambda p: length(p))), 0))::DOUBLE AS density FROM pieces LEFT JOIN found USING (id, place)),
    first AS (SELECT id, string_agg(CASE WHEN x = '' THEN '_' WHEN line >= {b.SURE} OR long >= {b.SURE} OR opening >= {b.SURE_OPENING} OR density >= {b.SURE} THEN 'B' WHEN plain THEN 'G' WHEN greatest(density, line, opening) >= {b.SOME} THEN 'L' ELSE 'S' END, '' ORDER BY place) AS letters FROM judged GROUP BY id),
    labelled AS MATERIALIZED (SELECT id, array_to_string(list_transform(runs, lambda r, i: CASE WHEN coalesce(runs[i - 1][1] = 'G', false) OR coalesce(runs[i + 1][1] = 'G', false)
        THEN translate(r, 'SL', 'GG') ELSE translate(r, 'SL', 'GB') END), '') AS labels FROM (SELECT id, regexp_extract_all(letters, '[SL_]+|G+|B+') AS runs FROM first))"""
_BODIES = f"""SELECT id, nullif(array_to_string(list_transform(list_filter(string_split(page, chr(10)), lambda x, i: labels[i] = 'G'), lambda x: trim(x, {_TRIM})), chr(10)), '') AS body FROM own LEFT JOIN labelled USING (id)"""
P2_FOUND = f"WITH {_FRAME} SELECT id, CAST(place AS INTEGER) AS line_no FROM (SELECT id, labels, unnest(range(1, length(labels) + 1)) AS place FROM labelled) WHERE labels[place] = 'B'"
P2_BODIES = f"WITH {_FRAME} {_BODIES}"


def reading_levels(least: int, unrolled: int = 14) -> str:
    """Levels by the same rounds over the document-word graph; rounds after the last one keep its words."""
    docs = f"SELECT doc_id, text FROM documents WHERE regexp_full_match(lower(trim(lang)), 'en(?:[-_].*)?') AND len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) >= {least}"

    def calibrated(i: int) -> str:
        """``w{i}``: the means ``m{i}`` on the scale of the grades, or the words before where these had settled."""
        fit = f"""read{i} AS (SELECT doc_id, sum(w * v) / sum(w) AS x FROM edges JOIN m{i} USING (word) JOIN own USING (doc_id) GROUP BY doc_id),
        fit{i} AS MATERIALIZED (SELECT avg(x) AS x, avg(g) AS g, CASE WHEN var_pop(x) > 1e-12 AND covar_pop(x, g) > 0 THEN covar_pop(x, g) / var_pop(x) ELSE 1 END AS b FROM read{i} JOIN own USING (doc_id)),
        n{i} AS MATERIALIZED (SELECT word, f.g + f.b * (v - f.x) AS v, den FROM m{i}, fit{i} f)"""
        if i == 1:
            return f"{fit}, w1 AS MATERIALIZED (SELECT *, false AS settled FROM n1)"
        return f"""{fit}, moved{i} AS MATERIALIZED (SELECT sum(n.den * abs(n.v - o.v)) / sum(n.den) < {TOLERANCE} AND NOT bool_or(o.v IS NULL) AS settled FROM n{i} n LEFT JOIN w{i - 1} o USING (word)),
        w{i} AS MATERIALIZED (SELECT * FROM w{i - 1} WHERE settled UNION ALL SELECT n.*, (SELECT settled FROM moved{i}) FROM n{i} n WHERE NOT (SELECT bool_or(settled) FROM w{i - 1}))"""

    rounds = "".join(
        f""", x{i} AS MATERIALIZED (SELECT doc_id, sum(w * v) / sum(w) AS x FROM edges JOIN w{i} USING (word) GROUP BY doc_id),
        m{i + 1} AS MATERIALIZED (SELECT word, sum(w * coalesce(g, x)) / sum(w) AS v, sum(w) AS den FROM edges LEFT JOIN own USING (doc_id) LEFT JOIN x{i} USING (doc_id) WHERE coalesce(g, x) IS NOT NULL GROUP BY word), {calibrated(i + 1)}"""
        for i in range(1, unrolled)
    )
    return f"""WITH docs AS MATERIALIZED ({docs}), tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]+')) AS word FROM docs),
        edges AS MATERIALIZED (SELECT doc_id, word, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS w FROM tokens GROUP BY doc_id, word),
        own AS MATERIALIZED (SELECT doc_id, avg(level) AS g FROM reading_labels WHERE doc_id IN (SELECT doc_id FROM docs) GROUP BY doc_id),
        m1 AS MATERIALIZED (SELECT word, sum(w * g) / sum(w) AS v, sum(w) AS den FROM edges JOIN own USING (doc_id) GROUP BY word), {calibrated(1)}{rounds},
        read AS MATERIALIZED (SELECT doc_id, x FROM docs LEFT JOIN (SELECT doc_id, sum(w * v) / sum(w) AS x FROM edges JOIN w{unrolled} USING (word) GROUP BY doc_id) USING (doc_id)),
        middle AS MATERIALIZED (SELECT CAST(round(g) AS INTEGER) AS level, quantile_disc(x, 0.5) AS m FROM read JOIN own USING (doc_id) GROUP BY 1),
        bounds AS MATERIALIZED (SELECT level, (m + lag(m) OVER (ORDER BY level)) / 2 AS low FROM middle)
        SELECT doc_id, CAST((SELECT max(level) FROM bounds WHERE low IS NULL OR x >= low) AS INTEGER) AS level FROM read"""


def _term(p: str, q: str) -> str:
    return f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) / 2 ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) / 2 ELSE 0 END)"


_PAIRS = ", ".join(f"({_quoted(w)}, {k})" for k, ws in enumerate(CLOSED.values()) for w in sorted(set(ws)))
_FIGURES = tuple(spam.SPREADS)
_MIDDLE = ", ".join(f"quantile_disc({c}, 0.5) AS m_{c}" for c in _FIGURES)
_APART = ", ".join(f"greatest(1.4826 * quantile_disc(abs({c} - m_{c}), 0.5), {s}) AS s_{c}" for c, s in spam.SPREADS.items())
#: Common tables up to ``flagged(id)``: the pages that are spam, from curves, divergences and norms as the operator has them.
_SPAM = f"""WITH {_FRAME}, bodies AS MATERIALIZED (SELECT id, body FROM ({_BODIES}) WHERE body IS NOT NULL),
    tokens AS (SELECT id, unnest(regexp_extract_all(lower(body), '(?:https?://|www\\.)\\S+|{_TOKEN}')) AS w FROM bodies),
    counts AS MATERIALIZED (SELECT id, CASE WHEN contains(w, '/') OR contains(w, '.') THEN '<address>' ELSE w END AS word, count(*) AS n FROM tokens GROUP BY 1, 2),
    tied AS (SELECT id, ln(n) AS y, m, n * m AS tokens, sum(m) OVER (PARTITION BY id ORDER BY n DESC) + 0.5 AS b FROM (SELECT id, n::DOUBLE AS n, count(*)::DOUBLE AS m FROM counts GROUP BY id, n)),
    placed AS (SELECT *, b - m AS a FROM tied),
    summed AS (SELECT id, sum(tokens) AS words, sum(m) AS w, sum((b * ln(b) - b) - (a * ln(a) - a)) AS sx, sum(b * (ln(b) * ln(b) - 2 * ln(b) + 2) - a * (ln(a) * ln(a) - 2 * ln(a) + 2)) AS sxx, sum(m * y) AS sy, sum(m * y * y) AS syy, sum(y * ((b * ln(b) - b) - (a * ln(a) - a))) AS sxy FROM placed GROUP BY id),
    fitted AS (SELECT id, words, w, sxx - sx * sx / w AS vxx, sxy - sx * sy / w AS vxy, syy - sy * sy / w AS vyy FROM summed),
    sloped AS (SELECT *, CASE WHEN vxx > 1e-9 AND vyy > 1e-9 THEN vxy / vxx ELSE 0 END AS slope, ln(w + 1) / ln(words + 1) AS extent FROM fitted WHERE words >= {spam.LEAST_WORDS}),
    curves AS MATERIALIZED (SELECT id, words, slope, sqrt(greatest(vyy - vxy * slope, 0) / w) AS residual, extent FROM sloped),
    listed(word, lang) AS (VALUES {_PAIRS}), sole AS (SELECT word, min(lang) AS lang FROM listed GROUP BY word HAVING count(*) = 1),
    hits AS (SELECT id, lang, sum(n) AS h, sum(sum(n)) OVER (PARTITION BY id) AS total FROM counts JOIN sole USING (word) GROUP BY id, lang),
    mix AS MATERIALIZED (SELECT c.id, l.lang, CASE WHEN t.id IS NULL THEN (l.lang = 0)::INT::DOUBLE ELSE coalesce(h.h / h.total, 0) END AS share
        FROM curves c CROSS JOIN (SELECT unnest(range({len(CLOSED)})) AS lang) l LEFT JOIN hits h ON h.id = c.id AND h.lang = l.lang LEFT JOIN (SELECT DISTINCT id FROM hits) t ON t.id = c.id),
    spoken AS (SELECT id, max(share) AS top, arg_min(lang, (-share, lang)) AS language FROM mix GROUP BY id),
    symbols AS MATERIALIZED (SELECT id, word, n / words AS p FROM counts JOIN curves USING (id) WHERE word = '<address>' OR word IN (SELECT word FROM listed)),
    shares AS (SELECT id, sum(CASE WHEN word = '<address>' THEN 0 ELSE p END) AS part, sum(CASE WHEN word = '<address>' THEN p ELSE 0 END) AS addresses FROM symbols GROUP BY id),
    pure AS MATERIALIZED (SELECT c.*, language, coalesce(part, 0) AS part, top >= 0.9 AND words >= {spam.REFERENCE_WORDS} AND coalesce(addresses, 0) <= {spam.REFERENCE_ADDRESSES} AS pure FROM curves c JOIN spoken USING (id) LEFT JOIN shares USING (id)),
    marked AS MATERIALIZED (SELECT p.*, coalesce(pure AND part >= {spam.REFERENCE_PART} * usual, false) AS prose FROM pure p LEFT JOIN (SELECT language, quantile_disc(part, 0.5) AS usual FROM pure WHERE pure GROUP BY language) USING (language)),
    sizes AS (SELECT language, count(*) AS size FROM marked WHERE prose GROUP BY language),
    means AS MATERIALIZED (SELECT language AS lang, word, sum(p) / any_value(size) AS q FROM symbols JOIN marked USING (id) JOIN sizes USING (language) WHERE prose GROUP BY language, word),
    rests AS (SELECT l.lang, 1 - coalesce(sum(q), 0) AS rest FROM (SELECT unnest(range({len(CLOSED)})) AS lang) l LEFT JOIN means m ON m.lang = l.lang GROUP BY l.lang),
    expected AS (SELECT s.id, s.word, any_value(s.p) AS p, sum(share * coalesce(q, 0)) AS q FROM symbols s JOIN mix x ON x.id = s.id LEFT JOIN means m ON m.lang = x.lang AND m.word = s.word GROUP BY s.id, s.word),
    sums AS (SELECT id, sum({_term('p', 'q')}) AS js, sum(p) AS p, sum(q) AS q FROM expected GROUP BY id),
    ends AS (SELECT id, sum(share * rest) AS q_rest FROM mix JOIN rests USING (lang) GROUP BY id),
    figures AS MATERIALIZED (SELECT id, words, slope, residual, extent, language, prose, least(floor(2 * log2(words)), {spam.LONGEST_CLASS}) AS cls, coalesce(js, 0) + {_term('p_rest', 'q_rest')} + greatest(1 - q_rest - coalesce(q, 0), 0) / 2 AS divergence
        FROM (SELECT m.*, s.js, s.q, greatest(1 - coalesce(s.p, 0), 0) AS p_rest, e.q_rest FROM marked m LEFT JOIN sums s USING (id) JOIN ends e USING (id))),
    classed AS (SELECT * FROM figures WHERE prose UNION ALL SELECT * REPLACE (-1 AS cls) FROM figures WHERE prose),
    twice AS (SELECT * FROM classed UNION ALL SELECT * REPLACE (-1 AS language) FROM classed),
    middle AS MATERIALIZED (SELECT language, cls, count(*) AS size, {_MIDDLE} FROM twice GROUP BY language, cls),
    norms AS MATERIALIZED (SELECT language AS l, cls AS c, any_value(size) AS size, {', '.join(f'any_value(m_{c}) AS m_{c}' for c in _FIGURES)}, {_APART} FROM twice JOIN middle USING (language, cls) GROUP BY language, cls),
    ranked AS (SELECT f.*, n.*, row_number() OVER (PARTITION BY f.id ORDER BY (l <> language), (c < 0), abs(c - cls), c) AS place FROM figures f JOIN norms n ON n.l IN (f.language, -1) AND (c < 0 OR size >= {spam.CLASS_LEAST})),
    first_scores AS MATERIALIZED (SELECT id, language, (divergence - m_divergence) / s_divergence AS z FROM ranked WHERE place = 1),
    homes AS (SELECT word, sum(k) AS uses, max(k) FILTER (language >= 0) AS k, arg_max(language, CASE WHEN language >= 0 THEN k ELSE 0 END) AS of
        FROM (SELECT word, CASE WHEN prose THEN language ELSE -1 END AS language, count(*) AS k FROM counts JOIN figures USING (id) GROUP BY 1, 2) GROUP BY word),
    vocabulary AS (SELECT word, of FROM homes JOIN sizes s ON s.language = of WHERE k >= {spam.OWN} * uses AND k >= {spam.COMMON} * size),
    strangers AS MATERIALIZED (SELECT id FROM (SELECT c.id, sum(CASE WHEN c.word <> '<address>' THEN n ELSE 0 END) AS whole, coalesce(sum(n) FILTER (c.word <> '<address>' AND of = f.language), 0) AS own
        FROM counts c JOIN first_scores f ON f.id = c.id AND f.z > {spam.FAR} LEFT JOIN vocabulary v ON v.word = c.word GROUP BY c.id) WHERE own < {spam.KNOWN} * whole),
    known AS (SELECT f.* REPLACE (CASE WHEN s.id IS NULL THEN language ELSE -1 END AS language), s.id IS NOT NULL AS strange FROM figures f LEFT JOIN strangers s ON s.id = f.id),
    again AS (SELECT f.*, n.*, row_number() OVER (PARTITION BY f.id ORDER BY (l <> language), (c < 0), abs(c - cls), c) AS place FROM known f JOIN norms n ON n.l IN (f.language, -1) AND (c < 0 OR size >= {spam.CLASS_LEAST})),
    scored AS MATERIALIZED (SELECT *, {', '.join(f'({c} - m_{c}) / s_{c} AS z_{c}' for c in _FIGURES if c != 'divergence')}, CASE WHEN NOT strange THEN (divergence - m_divergence) / s_divergence END AS z_divergence FROM again WHERE place = 1),
    causes AS (SELECT *, coalesce(z_divergence > {spam.FAR}, false) AS far, coalesce(greatest(abs(z_slope), z_residual, -z_extent) > {spam.CURVE_FAR}, false) AS curve FROM scored),
    flagged AS MATERIALIZED (SELECT id FROM causes WHERE far OR curve)"""
P3_FOUND = f"{_SPAM} SELECT id FROM flagged"
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in (*_FIGURES, *(f"z_{c}" for c in _FIGURES)))
P3_SCORES = f"{_SPAM} SELECT id, CAST(words AS BIGINT) AS words, {_ROUNDED}, CASE WHEN far AND curve THEN 'both' WHEN far THEN 'divergence' WHEN curve THEN 'curve' END AS cause, far OR curve AS flagged FROM causes"
_PAIRS_OF_PAGES = f"""{_SPAM}, texts AS (SELECT id, list_filter(string_split_regex(regexp_replace(lower(body), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]+', '', 'g'), '[\\s\\x{{85}}\\x{{A0}}\\x{{2000}}-\\x{{200B}}\\x{{3000}}]+'), lambda w: w <> '') AS ws FROM bodies WHERE id NOT IN (SELECT id FROM flagged)),
    runs AS MATERIALIZED (SELECT DISTINCT id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS run FROM (SELECT id, ws, unnest(range(1, len(ws) - 1)) AS i FROM texts)),
    measured AS (SELECT id, count(*) AS n FROM runs GROUP BY id),
    met AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS shared FROM runs a JOIN runs b ON a.run = b.run AND a.id < b.id GROUP BY 1, 2),
    alike AS MATERIALIZED (SELECT id_a, id_b FROM met JOIN measured a ON a.id = id_a JOIN measured b ON b.id = id_b WHERE shared >= 0.4 * (a.n + b.n - shared))"""
P6_FOUND = f"{_PAIRS_OF_PAGES} SELECT id_a, id_b FROM alike"
#: Groups by a recursive walk over the pairs.
P6_CLASSES = f"""{_PAIRS_OF_PAGES.replace('WITH ', 'WITH RECURSIVE ', 1)}, both_ways AS MATERIALIZED (SELECT id_a AS x, id_b AS y FROM alike UNION ALL SELECT id_b, id_a FROM alike),
    walk AS (SELECT x, y FROM both_ways UNION SELECT w.x, b.y FROM walk w JOIN both_ways b ON b.x = w.y)
    SELECT o.id, least(o.id, coalesce(min(w.y), o.id)) AS class, coalesce(any_value(k), 0) AS links FROM measured o LEFT JOIN walk w ON w.x = o.id LEFT JOIN (SELECT x, count(*) AS k FROM both_ways GROUP BY x) l ON l.x = o.id GROUP BY o.id"""
