"""DuckDB SQL equal to the queries of the driver plan, composed of named parts."""

from __future__ import annotations

from ..functions.text import STOPWORDS
from ..operators.resolve import RULES
from ..operators.segments import CHUNKS_A_DOC
from ..sources import documents as D
from .driver import AUTHORITY, LISTING, SIGNALS

_STOP = "(" + ", ".join(f"'{w}'" for w in sorted(STOPWORDS)) + ")"


def _keeps(w: str) -> str:
    return f"({w} NOT IN {_STOP} AND length({w}) >= 2 AND NOT (regexp_full_match({w}, '[0-9]+') AND length({w}) < 3))"


def _undoubled(x: str) -> str:
    return f"CASE WHEN length({x}) > 3 AND right({x}, 1) = left(right({x}, 2), 1) THEN left({x}, length({x}) - 1) ELSE {x} END"


def _stem(w: str) -> str:
    cut = lambda n: f"left({w}, length({w}) - {n})"
    return (
        f"CASE WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN {cut(3)} || 'y' WHEN length({w}) > 5 AND {w} LIKE '%ing' THEN {_undoubled(cut(3))} "
        f"WHEN length({w}) > 4 AND {w} LIKE '%ed' AND {w} NOT LIKE '%eed' THEN {_undoubled(cut(2))} "
        f"WHEN length({w}) > 3 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND {w} NOT LIKE '%us' AND {w} NOT LIKE '%is' THEN {cut(1)} ELSE {w} END"
    )


def _words(x: str) -> str:
    return f"unnest(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _string(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _html(x: str) -> str:
    """Text of a page: cut at its headings, which are put back as Markdown."""
    heads = "|".join(f"<h{n}[^>]*>.*?</h{n}>" for n in range(1, 7))
    bare = f"regexp_replace(coalesce({x}, ''), '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'gis')"
    inner = r"trim(regexp_replace(regexp_replace(h, '^<h[1-6][^>]*>|</h[1-6]>$', '', 'gis'), '<[^>]+>', '', 'g'), chr(32) || chr(10) || chr(9))"
    mark = f"chr(10) || chr(10) || repeat('#', CAST(regexp_extract(h, '^<h([1-6])', 1, 'i') AS INT)) || ' ' || {inner} || chr(10) || chr(10)"
    marked = f"list_transform(regexp_extract_all({bare}, '{heads}', 0, 'is'), lambda h: {mark})"
    whole = f"array_to_string(list_transform(regexp_split_to_array({bare}, '{heads}', 'is'), lambda x, i: x || coalesce(({marked})[i], '')), '')"
    plain = f"regexp_replace(regexp_replace({whole}, '</?({D.BLOCKS})[^>]*>', chr(10) || chr(10), 'gi'), '<[^>]+>', ' ', 'g')"
    for entity, c in (("&quot;", chr(34)), ("&copy;", chr(169)), ("&middot;", chr(183)), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = f"replace({plain}, '{entity}', {_string(c)})"
    return rf"trim(regexp_replace(regexp_replace({plain}, '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10) || chr(10), 'g'), chr(32) || chr(10))"


def _title(text: str, name: str) -> str:
    heads = f"list_filter(list_transform(string_split({text}, chr(10))[:40], lambda l: trim(l)), lambda l: regexp_matches(l, '{D.HEADING}'))"
    return f"coalesce(regexp_extract(({heads})[1], '{D.HEADING}', 2), {name})"


_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'domain')"
_BM25 = "sum(weight * idf * f * 2.4e0 / (f + 1.4e0 * (0.25e0 + 0.75e0 * dl / avgdl)))"

PARTS = {
    "chunks": "SELECT doc_id AS chunk_id, source || '/' || doc_id || '.txt' AS doc, CAST(doc_id AS VARCHAR) AS title, source AS folder, '' AS section, text FROM documents WHERE trim(text) <> ''",
    "words": f"SELECT chunk_id, {_words('text')} AS word FROM chunks",
    "spoken": f"SELECT chunk_id, word FROM (SELECT chunk_id, {_words('title || chr(10) || section || chr(10) || text')} AS word FROM chunks) WHERE {_keeps('word')}",
    "postings": f"SELECT chunk_id, {_stem('word')} AS term, count(*) AS f FROM spoken GROUP BY 1, 2",
    "lengths": "SELECT chunk_id, CAST(coalesce(sum(f), 0) AS BIGINT) AS dl FROM chunks LEFT JOIN postings USING (chunk_id) GROUP BY 1",
    "corpus": "SELECT count(*) AS n, coalesce(avg(dl), 1e0) AS avgdl FROM lengths",
    "terms": "SELECT term, df, ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) AS idf FROM (SELECT term, count(*) AS df FROM postings GROUP BY 1), corpus",
    "surfaces": f"SELECT term, surface FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, surface) AS nth FROM (SELECT {_stem('word')} AS term, word AS surface, count(*) AS n FROM spoken GROUP BY 1, 2)) WHERE nth = 1",
    "q": f"SELECT query_id, {_stem('word')} AS term, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT item_id AS query_id, {_words('text')} AS word FROM benchmark WHERE text <> '') WHERE {_keeps('word')} GROUP BY 1, 2",
    "scores": f"SELECT query_id, chunk_id, {_BM25} AS score FROM q JOIN postings USING (term) JOIN terms USING (term) JOIN lengths USING (chunk_id), corpus GROUP BY 1, 2",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scores",
    "plain": "SELECT * FROM ranked WHERE rank <= 8",
    "members": f"SELECT {_SLUG.format('folder')} AS id, chunk_id, doc, folder FROM chunks WHERE folder <> ''",
    "vectors": """SELECT doc, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc)) AS x FROM (
        SELECT doc, term, (1 + ln(f)) * ln((n + 1) / (df + 0.5e0)) AS x FROM (SELECT doc, term, f, count(*) OVER (PARTITION BY term) AS df FROM postings JOIN chunks USING (chunk_id)), (SELECT count(*) AS n FROM chunks))""",
    "distinctive": """SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY round(weight, 12) DESC, term) AS nth FROM (
        SELECT area_id, term, f / total * idf * (ln((groups + 1) / areas) + 0.1e0) AS weight FROM (
            SELECT id AS area_id, term, CAST(sum(f) AS DOUBLE) AS f, CAST(sum(sum(f)) OVER (PARTITION BY id) AS DOUBLE) AS total, CAST(count(*) OVER (PARTITION BY term) AS DOUBLE) AS areas FROM postings JOIN members USING (chunk_id) GROUP BY 1, 2
        ) JOIN terms USING (term), (SELECT count(DISTINCT id) AS groups FROM members) WHERE NOT regexp_full_match(term, '[0-9]+') AND length(term) >= 3)""",
    "signals": f"SELECT * FROM (VALUES {_values(SIGNALS)}) AS t(id, nth, phrase)",
    "modes": f"SELECT * FROM (VALUES {_values(AUTHORITY)}) AS t(id, authority)",
    "areas": "SELECT row_number() OVER (ORDER BY id) AS ord, id, coalesce(authority, 'project') AS authority, upper(left(id, 1)) || substr(id, 2) AS label, documents FROM (SELECT id, count(*) AS documents FROM members GROUP BY 1) LEFT JOIN modes USING (id)",
    "aliases": f"""SELECT id, term, max(weight) AS weight FROM (
        SELECT area_id AS id, term, round(weight, 9) AS weight FROM distinctive WHERE nth <= 15 UNION ALL
        SELECT id, {_stem('id')} AS term, (SELECT max(round(weight, 9)) FROM distinctive d WHERE d.area_id = areas.id) AS weight FROM areas) GROUP BY 1, 2""",
    "toks": f"SELECT DISTINCT id, nth, phrase, {_stem('word')} AS term FROM (SELECT id, nth, phrase, {_words('phrase')} AS word FROM signals) WHERE {_keeps('word')}",
    "sig_hits": """SELECT query_id, id, nth, phrase, CASE WHEN met = size AND size >= 2 THEN 1e0 WHEN met = size THEN 0.75e0 WHEN met >= 0.6e0 * size AND size >= 3 THEN 0.6e0 * met / size END AS s FROM (
        SELECT query_id, t.id, t.nth, t.phrase, count(*) AS met, any_value(size) AS size FROM (SELECT *, count(*) OVER (PARTITION BY id, nth) AS size FROM toks) t JOIN q USING (term) GROUP BY 1, 2, 3, 4)""",
    "sig": "SELECT query_id, id, max(s) AS sig, string_agg(phrase, '|' ORDER BY nth) AS phrases FROM sig_hits WHERE s IS NOT NULL GROUP BY 1, 2",
    "ali": "SELECT query_id, id, least(1e0, sum(weight_a / top) / 1.5e0) AS ali FROM (SELECT id, term, weight AS weight_a, max(weight) OVER (PARTITION BY id) AS top FROM aliases) JOIN q USING (term) GROUP BY 1, 2",
    "rel": "SELECT query_id, id, max(score) / any_value(best) AS rel FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM scores) JOIN members USING (chunk_id) GROUP BY 1, 2",
    "scored": """SELECT query_id, id, ord, authority, label, 1 - (1 - coalesce(sig, 0e0)) * (1 - 0.8e0 * coalesce(ali, 0e0)) * (1 - 0.7e0 * coalesce(rel, 0e0)) AS score
        FROM (SELECT query_id, id FROM sig UNION SELECT query_id, id FROM ali UNION SELECT query_id, id FROM rel) LEFT JOIN sig USING (query_id, id) LEFT JOIN ali USING (query_id, id) LEFT JOIN rel USING (query_id, id) JOIN areas USING (id)""",
    "activated": """SELECT query_id, id, label, authority, CASE WHEN authority = 'training' THEN 'parked' ELSE 'active' END AS state, score, CAST(nth AS INT) AS nth FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, authority = 'training' ORDER BY round(score, 9) DESC, ord) AS nth FROM scored WHERE round(score, 9) >= 0.4e0) WHERE authority = 'training' OR nth <= 4""",
    "live": "SELECT query_id, id, nth AS stage, score AS area, sum(score) OVER (PARTITION BY query_id) AS total FROM activated WHERE state = 'active'",
    "spoken_phrases": f"SELECT id, nth, {_stem('word')} AS term FROM (SELECT id, nth, {_words('phrase')} AS word FROM signals) WHERE {_keeps('word')}",
    "met": "SELECT query_id, id, nth, phrase FROM sig_hits WHERE s IS NOT NULL",
    "focus_terms": """SELECT query_id, id, term, sum(w) AS weight FROM (
        SELECT query_id, live.id, term, weight AS w FROM live JOIN q USING (query_id)
        UNION ALL SELECT query_id, id, term, 1e0 AS w FROM met JOIN toks USING (id, nth) JOIN live USING (query_id, id)
        UNION ALL SELECT query_id, id, term, 0.3e0 AS w FROM (SELECT DISTINCT query_id, id FROM met) JOIN live USING (query_id, id) JOIN spoken_phrases USING (id)) GROUP BY 1, 2, 3""",
    "focused": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, domain_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
        SELECT query_id, id AS domain_id, chunk_id, {_BM25} AS score FROM focus_terms JOIN postings USING (term) JOIN members USING (id, chunk_id) JOIN terms USING (term) JOIN lengths USING (chunk_id), corpus GROUP BY 1, 2, 3)) WHERE rank <= 12""",
    "reps": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
        SELECT id AS domain_id, chunk_id, {_BM25} AS score FROM (SELECT id, term, 1e0 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) AS nth FROM aliases) WHERE nth <= 6)
        JOIN postings USING (term) JOIN members USING (id, chunk_id) JOIN terms USING (term) JOIN lengths USING (chunk_id), corpus GROUP BY 1, 2)) WHERE rank <= 2""",
    # the words of a question in the order of their first use, and why an area is active
    "said": f"SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(place)) AS pos FROM (SELECT query_id, place, {_stem('word')} AS term FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) AS place FROM benchmark WHERE text <> '') WHERE {_keeps('word')}) GROUP BY 1, 2",
    "mentions": "SELECT query_id, id, string_agg(surface, ', ' ORDER BY pos) AS shown FROM (SELECT query_id, id, pos, coalesce(surface, term) AS surface, row_number() OVER (PARTITION BY query_id, id ORDER BY pos) AS nth FROM said JOIN aliases USING (term) LEFT JOIN surfaces USING (term)) WHERE nth <= 4 GROUP BY 1, 2",
    "quoted": "SELECT query_id, id, string_agg('\"' || phrase || '\"', ', ' ORDER BY nth) AS phrases FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY nth) AS k FROM met) WHERE k <= 2 GROUP BY 1, 2",
    "reasoned": """SELECT query_id, id, state, coalesce(concat_ws('; ', CASE WHEN phrases IS NOT NULL THEN 'sounds like ' || phrases END, CASE WHEN shown IS NOT NULL THEN 'mentions ' || shown END,
        CASE WHEN phrases IS NULL AND shown IS NULL AND rel >= 0.5e0 THEN 'strong text match' END), '') AS reasons
        FROM activated LEFT JOIN quoted USING (query_id, id) LEFT JOIN mentions USING (query_id, id) LEFT JOIN rel USING (query_id, id)""",
    # the passages: candidates in order, then a walk that carries what was taken
    "hits": "SELECT query_id, chunk_id, rank, coalesce(m.id, '') AS own, round(score - 0.35e0 * max(score) OVER (PARTITION BY query_id), 9) >= 0 AS strong FROM plain LEFT JOIN members m USING (chunk_id)",
    "may": """SELECT query_id, 0 AS stage, 0 AS kind, rank, chunk_id, own AS domain_id, 'question' AS via, 0e0 AS area, 0e0 AS total FROM hits WHERE rank <= 2
        UNION ALL SELECT query_id, 99, 0, rank, chunk_id, own, 'question', 0e0, 0e0 FROM hits WHERE strong
        UNION ALL SELECT live.query_id, stage, 1, f.rank, f.chunk_id, f.domain_id, CASE WHEN h.chunk_id IS NULL THEN 'area' ELSE 'question' END, area, total FROM live JOIN focused f ON f.query_id = live.query_id AND f.domain_id = live.id LEFT JOIN hits h ON h.query_id = live.query_id AND h.chunk_id = f.chunk_id
        UNION ALL SELECT live.query_id, stage, 2, r.rank, r.chunk_id, r.domain_id, CASE WHEN h.chunk_id IS NULL THEN 'area' ELSE 'question' END, area, total FROM live JOIN reps r ON r.domain_id = live.id LEFT JOIN hits h ON h.query_id = live.query_id AND h.chunk_id = r.chunk_id
            WHERE EXISTS (SELECT 1 FROM reasoned w WHERE w.query_id = live.query_id AND w.id = live.id AND w.reasons <> '') AND NOT EXISTS (SELECT 1 FROM focused f WHERE f.query_id = live.query_id AND f.domain_id = live.id)""",
    "line": """SELECT may.*, least(length(text), 1204) AS chars, EXISTS (SELECT 1 FROM activated a WHERE a.state = 'parked' AND a.query_id = may.query_id AND a.id = may.domain_id) AS parked,
        row_number() OVER (PARTITION BY query_id ORDER BY stage, kind, rank, chunk_id) AS place FROM may JOIN chunks USING (chunk_id)""",
    "walk": """SELECT query_id, CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS taken, CAST([] AS VARCHAR[]) AS how, CAST(0 AS BIGINT) AS used, -1 AS stage, CAST(0 AS BIGINT) AS quota, CAST(0 AS BIGINT) AS got FROM (SELECT DISTINCT query_id FROM line)
        UNION ALL SELECT query_id, place, CASE WHEN fits THEN list_append(taken, chunk_id) ELSE taken END, CASE WHEN fits THEN list_append(how, via || '|' || domain_id) ELSE how END, used + CASE WHEN fits THEN chars ELSE 0 END, stage, quota, got + CASE WHEN fits THEN 1 ELSE 0 END FROM (
            SELECT *, got < quota AND rank <= CASE kind WHEN 1 THEN quota + 4 WHEN 2 THEN least(2, quota) ELSE 8 END AND len(taken) < 8 AND NOT parked AND NOT list_contains(taken, chunk_id) AND (len(taken) = 0 OR used + chars <= 9000) AS fits FROM (
                SELECT l.query_id, l.place, w.taken, w.how, w.used, l.stage, l.chunk_id, l.via, l.domain_id, l.chars, l.kind, l.rank, l.parked, CASE WHEN l.stage <> w.stage THEN 0 ELSE w.got END AS got,
                    CASE WHEN l.stage = w.stage THEN w.quota WHEN l.kind = 0 THEN 8 WHEN l.total > 0 THEN greatest(1, CAST(ceil(round((8 - len(w.taken)) * l.area / l.total, 9)) AS BIGINT)) ELSE 1 END AS quota
                FROM walk w JOIN line l ON l.query_id = w.query_id AND l.place = w.place + 1))""",
    "packed": """SELECT query_id, CAST(n AS INT) AS n, chunk_id, string_split(how, '|')[1] AS via, string_split(how, '|')[2] AS domain_id FROM (
        SELECT query_id, unnest(taken) AS chunk_id, unnest(how) AS how, generate_subscripts(taken, 1) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place DESC) AS back FROM walk) WHERE back = 1)""",
    "expected": "SELECT item_id AS query_id, arg_min(doc, chunk_id) AS expect FROM benchmark b JOIN chunks c ON contains(c.text, b.text) GROUP BY 1",
    "evaluated": """SELECT query_id, EXISTS (SELECT 1 FROM plain p JOIN chunks c USING (chunk_id) WHERE p.query_id = e.query_id AND contains(c.doc, e.expect)) AS baseline_hit,
        EXISTS (SELECT 1 FROM packed p JOIN chunks c USING (chunk_id) WHERE p.query_id = e.query_id AND contains(c.doc, e.expect)) AS engine_hit,
        (SELECT count(*) FROM activated a WHERE a.state = 'active' AND a.query_id = e.query_id) AS active FROM expected e""",
    # areas with the user's edits
    "top": "SELECT area_id AS id, max(round(weight, 6)) AS top FROM distinctive WHERE nth <= 15 GROUP BY 1",
    "edits": "SELECT * FROM (VALUES ('src1', 'Second', 'notes', ['erea'], ['the car broke'], 'training', NULL), ('src3', NULL, NULL, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), 'watch', 'https://example.com/3'), ('src4', NULL, NULL, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), NULL, NULL)) AS t(id, u_label, u_description, ua, us, u_mode, watch_url)",
    "lifted": f"""SELECT id, {_stem('word')} AS term FROM (SELECT id, {_words("concat_ws(' ', id, label, u_label, array_to_string(ua, ' '))")} AS word FROM areas LEFT JOIN edits USING (id)) WHERE {_keeps('word')}""",
    "entries": "SELECT id, string_agg(term || '=' || CAST(round(w * 1e6) AS BIGINT), ',' ORDER BY term || '=' || CAST(round(w * 1e6) AS BIGINT)) AS alias_stems FROM (SELECT id, term, max(w) AS w FROM (SELECT area_id AS id, term, round(weight, 6) AS w FROM distinctive WHERE nth <= 15 UNION ALL SELECT id, term, top AS w FROM lifted JOIN top USING (id)) GROUP BY 1, 2) GROUP BY 1",
    "shown": "SELECT area_id AS id, list(surface ORDER BY nth) AS words FROM distinctive JOIN surfaces USING (term) WHERE nth <= 15 GROUP BY 1",
    "firsts": "SELECT id, string_agg(doc, '|' ORDER BY doc) AS first_docs FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc) AS nth FROM members) WHERE nth <= 6 GROUP BY 1",
    "own_signals": "SELECT id, list(phrase ORDER BY nth) AS phrases FROM signals GROUP BY 1",
    "merged": """SELECT CAST(ord AS INT) AS ord, id, 'folder' AS source, coalesce(u_label, label) AS label, coalesce(u_description, '') AS description, documents, documents AS chunk_count, first_docs, alias_stems, coalesce(u_mode, 'project') AS authority, watch_url,
        list_concat(coalesce(ua, []), list_filter(words, lambda w: NOT list_contains(coalesce(ua, []), w))) AS aliases, list_concat(coalesce(us, []), list_filter(coalesce(phrases, []), lambda w: NOT list_contains(coalesce(us, []), w))) AS signals
        FROM areas LEFT JOIN edits USING (id) JOIN entries USING (id) JOIN shown USING (id) JOIN firsts USING (id) LEFT JOIN own_signals USING (id)""",
    "page_texts": f"SELECT page_id, {_html('html')} AS text FROM pages",
    "cut": """SELECT doc, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS rest, '' AS piece, 0 AS n FROM chunks
        UNION ALL SELECT doc, regexp_replace(substr(rest, stop + 1), '^\\s+', ''), left(rest, stop), n + 1 FROM (
            SELECT *, CASE WHEN length(rest) <= 1600 THEN length(rest) WHEN strpos(reverse(left(rest, 1600)), ' ') BETWEEN 1 AND 1149 THEN 1600 - strpos(reverse(left(rest, 1600)), ' ') ELSE 1600 END AS stop FROM cut WHERE rest <> '')""",
    "ids": f"SELECT page_id AS ord, row_number() OVER (ORDER BY page_id) AS place, {_SLUG.format(chr(39).join(['regexp_extract(url, ', '^[a-z]+://([^/]+)', ', 1)']))} AS id FROM pages",
    "given": """SELECT CAST(0 AS BIGINT) AS place, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS BIGINT) AS ord, '' AS id
        UNION ALL SELECT i.place, list_append(used, list_filter(list_transform(range(1, len(used) + 2), lambda n: CASE WHEN n > 1 THEN i.id || '-' || n ELSE i.id END), lambda x: NOT list_contains(used, x))[1]), i.ord,
            list_filter(list_transform(range(1, len(used) + 2), lambda n: CASE WHEN n > 1 THEN i.id || '-' || n ELSE i.id END), lambda x: NOT list_contains(used, x))[1] FROM given g JOIN ids i ON i.place = g.place + 1""",
    "listing": f"SELECT replace(replace(([{', '.join(_string(x) for x in LISTING)}])[doc_id % {len(LISTING)} + 1], 'S', source), 'N', CAST(doc_id AS VARCHAR)) AS path, n_chars AS size, doc_id FROM documents",
}
#: Instead of chunks that are documents: those of whole texts, whose paragraphs have single line ends and no headings.
CUT = {
    "texts": "SELECT doc_id, source || '/' || doc_id || '.txt' AS doc, CAST(doc_id AS VARCHAR) AS title, source AS folder, text FROM documents WHERE doc_id IS NOT NULL AND trim(text) <> ''",
    "cut": PARTS["cut"].replace("SELECT doc, ", "SELECT doc_id, ").replace("FROM chunks", "FROM texts"),
    "chunks": f"SELECT doc_id * {CHUNKS_A_DOC} + n - 1 AS chunk_id, doc, title, folder, '' AS section, trim(piece, chr(32) || chr(10)) AS text FROM cut JOIN texts USING (doc_id) WHERE n > 0",
}
_RANK = "CAST(rank AS INT) AS rank"
_PASSAGE = "CASE WHEN length(text) <= 1200 THEN text ELSE substr(text, 1, 1200) || ' ...' END AS text"

#: query: the parts it needs in order, and its select.
_QUERIES = {
    "tokenize": "SELECT chunk_id, word, count(*) AS n FROM words GROUP BY 1, 2",
    "stem": f"SELECT DISTINCT word, {_stem('word')} AS stem FROM words",
    "tokenize_filter": f"SELECT word, count(*) AS n FROM words WHERE {_keeps('word')} GROUP BY 1",
    "term_freq": "SELECT chunk_id, term, f FROM postings", "chunk_len": "SELECT chunk_id, dl FROM lengths", "doc_freq": "SELECT term, df FROM terms",
    "corpus_stats": "SELECT n, round(avgdl, 6) AS avgdl FROM corpus", "term_idf": "SELECT term, round(idf, 6) AS idf FROM terms",
    "query_weights": f"""SELECT query_id, {_stem('word')} AS term, round(sum(CASE WHEN back = 1 THEN 1e0 ELSE 0.4e0 END), 6) AS weight FROM (
        SELECT query_id, back, {_words('text')} AS word FROM (SELECT conv_id AS query_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE text <> '') WHERE back <= 6) WHERE {_keeps('word')} GROUP BY 1, 2""",
    "bm25_search": f"SELECT query_id, chunk_id, round(score, 6) AS score, {_RANK} FROM plain",
    "baseline_search": "SELECT query_id, CAST(rank AS INT) AS n, doc, section, text, round(score, 6) AS score FROM ranked JOIN chunks USING (chunk_id) WHERE rank <= 6",
    "folder_areas": "SELECT id AS area_id, doc FROM members", "surface_form": "SELECT term, surface FROM surfaces",
    "doc_tfidf": "SELECT doc, term, round(x, 6) AS x FROM vectors",
    "doc_cosine": "SELECT a.doc AS a, b.doc AS b, round(sum(a.x * b.x), 6) AS cosine FROM vectors a JOIN vectors b ON a.term = b.term AND a.doc <> b.doc WHERE a.doc IN (SELECT min(doc) FROM chunks GROUP BY folder) GROUP BY 1, 2",
    "distinctive_terms": "SELECT area_id, term, round(weight, 6) AS weight, CAST(nth AS INT) AS nth FROM distinctive WHERE nth <= 15",
    "slugify": f"SELECT conv_id, turn, {_SLUG.format('text')} AS slug FROM conversations",
    "area_ids": "SELECT ord, id FROM given WHERE place > 0",
    "area_summary": "SELECT id, label, description, authority, watch_url, documents, chunk_count, array_to_string(aliases[:12], '|') AS aliases, array_to_string(signals[:12], '|') AS signals FROM merged",
    "merge_domains": "SELECT ord, id, source, label, description, documents, chunk_count, first_docs, array_to_string(aliases, '|') AS aliases, alias_stems, array_to_string(signals, '|') AS signals, authority, watch_url FROM merged",
    "focused_search": "SELECT query_id, domain_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM focused",
    "activation_reasons": "SELECT query_id, id, state, reasons FROM reasoned",
    "pack": f"SELECT query_id, n, doc, section, {_PASSAGE}, domain_id, via FROM packed JOIN chunks USING (chunk_id)",
    "eval_recall": "SELECT count(*) AS questions, round(coalesce(avg(CAST(baseline_hit AS DOUBLE)), 0e0), 6) AS baseline_recall, round(coalesce(avg(CAST(engine_hit AS DOUBLE)), 0e0), 6) AS engine_recall FROM evaluated",
    "eval_buckets": "SELECT CASE WHEN engine_hit AND NOT baseline_hit THEN 'rescued' WHEN baseline_hit AND NOT engine_hit THEN 'lost' WHEN NOT baseline_hit THEN 'both_missed' ELSE 'both_hit' END AS bucket, count(*) AS n, CAST(sum(active) AS BIGINT) AS active FROM evaluated GROUP BY 1",
    "html_to_text": "SELECT page_id, text FROM page_texts",
    "guess_title": f"SELECT page_id, {_title('text', _string('page'))} AS title FROM page_texts",
    "chunk_text": "SELECT doc, CAST(n - 1 AS INT) AS chunk_ord, '' AS section, trim(piece, chr(32) || chr(10)) AS text FROM cut WHERE n > 0",
    # only lines that begin with "The " change, and each at its place
    "line_diff": """WITH l AS (SELECT doc_id AS id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth FROM documents),
        c AS (SELECT id, count(*) AS n, list('A ' || substr(line, 5) ORDER BY nth)[:5] AS added, list(line ORDER BY nth)[:5] AS removed FROM l WHERE nth > 1 AND line LIKE 'The %' GROUP BY 1)
        SELECT doc_id AS id, CAST(coalesce(n, 0) AS INT) AS lines_added, CAST(coalesce(n, 0) AS INT) AS lines_removed, coalesce(array_to_string(added, chr(10)), '') AS sample_added, coalesce(array_to_string(removed, chr(10)), '') AS sample_removed FROM documents LEFT JOIN c ON c.id = doc_id""",
    "load_questions": "SELECT text AS question, CAST(item_id AS VARCHAR) AS expect FROM benchmark",
    "humanize": r"SELECT page_id, array_to_string(list_transform(regexp_extract_all(lower(trim(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[-_]+', ' ', 'g'))), '\pL+|\PL+'), lambda w: upper(left(w, 1)) || substr(w, 2)), '') AS label FROM pages",
    "authority_rules": f"SELECT query_id, string_agg('- ' || label || ': ' || CASE WHEN state = 'parked' THEN {_string(RULES['parked'])} WHEN authority = 'ask' THEN {_string(RULES['ask'])} ELSE {_string(RULES['project'])} END, chr(10) ORDER BY state, nth) AS rules FROM activated GROUP BY 1",
    "extract_json": "SELECT conv_id, turn, sha256(text) AS sha256 FROM conversations",
    "snapshot_diff": """WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS path, n_chars + CASE WHEN CAST(doc_id AS VARCHAR) LIKE '%3' THEN 1 ELSE 0 END AS size FROM documents WHERE CAST(doc_id AS VARCHAR) NOT LIKE '%7' UNION ALL SELECT doc_id || 'x', n_chars FROM documents WHERE CAST(doc_id AS VARCHAR) LIKE '%5'),
        b AS (SELECT CAST(doc_id AS VARCHAR) AS path, n_chars AS size FROM documents) SELECT path, CASE WHEN a.size IS NULL THEN 'added' WHEN b.size IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (path) WHERE a.size IS DISTINCT FROM b.size""",
    "scan_files": f"""SELECT row_number() OVER (ORDER BY list_transform(string_split(path, '/'), lambda x, i: CASE WHEN i = len(string_split(path, '/')) THEN '0' ELSE '1' END || x)) - 1 AS doc_ord, path, size FROM listing WHERE NOT regexp_matches(path, '(^|/)\\.') AND path NOT LIKE '%node_modules/%' AND NOT path LIKE '%.exe'""",
    "chunk_domain": "SELECT chunk_id, id FROM members", "signal_score": "SELECT query_id, id, round(sig, 6) AS sig, phrases FROM sig",
    "alias_score": "SELECT query_id, id, round(ali, 6) AS ali FROM ali", "area_relevance": "SELECT query_id, id, round(rel, 6) AS rel FROM rel",
    "area_score": "SELECT query_id, id, round(score, 6) AS score FROM scored", "activate_areas": "SELECT query_id, id, state, nth, round(score, 6) AS score FROM activated",
    "ask_areas": "SELECT query_id, id, label FROM activated WHERE state = 'active' AND authority = 'ask'",
    "plain_head": f"SELECT query_id, {_RANK}, doc, {_PASSAGE} FROM plain JOIN chunks USING (chunk_id) WHERE rank <= 2",
    "parked_exclusion": f"SELECT query_id, m.id, chunk_id, {_RANK} FROM plain LEFT JOIN members m USING (chunk_id) WHERE NOT EXISTS (SELECT 1 FROM activated a WHERE a.state = 'parked' AND a.query_id = plain.query_id AND a.id = m.id)",
    "plain_fill": f"SELECT query_id, chunk_id, {_RANK} FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM plain) WHERE round(score - 0.35e0 * best, 9) >= 0",
    "search_in_area": "SELECT query_id, 'src2' AS domain_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scores JOIN members USING (chunk_id) WHERE id = 'src2') WHERE rank <= 8",
    "restricted_search": f"""SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT query_id || ':all' AS query_id, chunk_id, score, rank FROM ranked UNION ALL
        SELECT query_id || ':sound', chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) FROM scores WHERE chunk_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)) WHERE rank <= 8""",
    "quoted_items": r"""SELECT query_id, chunk_id FROM chunks JOIN (SELECT item_id || ':' || part AS query_id, regexp_extract(text, pattern, 0) AS item
        FROM benchmark, (VALUES ('text', '^[\s\S]*'), ('two', '^\S+\s+\S+'), ('word', '^\S+')) AS p(part, pattern)) i ON item <> '' AND contains(text, item)""",
    "area_representatives": f"""SELECT domain_id, chunk_id, round(score, 6) AS score, {_RANK} FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
        SELECT id AS domain_id, chunk_id, {_BM25} AS score FROM (SELECT id, term, 1e0 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) AS nth FROM aliases) WHERE nth <= 6)
        JOIN postings USING (term) JOIN members USING (id, chunk_id) JOIN terms USING (term) JOIN lengths USING (chunk_id), corpus GROUP BY 1, 2)) WHERE rank <= 2""",
    "load_documents": f"SELECT doc, title, folder, length(text) AS chars FROM chunks UNION ALL SELECT 'pages/' || page_id || '.html', {_title('text', 'CAST(page_id AS VARCHAR)')}, 'pages', length(text) FROM page_texts WHERE text <> ''", "content_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "cluster_carryover": """WITH d AS (SELECT doc_id, CAST(doc_id % 7 AS INT) AS cluster, CASE WHEN doc_id % 5 = 0 THEN 6 ELSE doc_id % 7 END AS was FROM documents),
        o AS (SELECT cluster, 'old' || was AS area_id, count(*) AS k FROM d GROUP BY 1, 2), s AS (SELECT *, CAST(k AS DOUBLE) / ((SELECT count(*) FROM d WHERE d.cluster = o.cluster) + (SELECT count(*) FROM d WHERE 'old' || d.was = o.area_id) - k) AS overlap FROM o)
        SELECT cluster, area_id, round(overlap, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY overlap DESC, area_id) AS nth FROM s WHERE overlap >= 0.5) WHERE nth = 1""",
    "watch_status": """SELECT page_id AS id, CASE page_id % 5 WHEN 4 THEN 'error' WHEN 1 THEN 'unchanged' WHEN 2 THEN 'awaiting review' WHEN 0 THEN 'new' ELSE 'changed' END AS status,
        CASE WHEN page_id % 5 <> 4 THEN sha256(coalesce(html, '')) END AS sha256 FROM pages""",
}


def composed(select: str, **parts: str) -> str:
    """The select with those parts it draws on, directly or through others; own parts come first and replace others."""
    import re

    known = parts | {n: sql for n, sql in PARTS.items() if n not in parts}
    needed: set[str] = set()
    todo = [select]
    while todo:
        sql = todo.pop()
        for name in known:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+\(?{name}\b|, {name}\b", sql):
                needed.add(name)
                todo.append(known[name])
    own = [f"{n} AS ({known[n]})" for n in known if n in needed]
    if select.startswith("WITH ") or not own:
        return select
    return f"WITH RECURSIVE {', '.join(own)} {select}"


ORACLES = {name: composed(sql) for name, sql in _QUERIES.items()} | {
    "incremental_index": composed(f"SELECT chunk_id, term, df, round({_BM25.replace('sum(weight * ', '(')}, 6) AS weight FROM postings JOIN lengths USING (chunk_id) JOIN terms USING (term), corpus", **CUT),
}
