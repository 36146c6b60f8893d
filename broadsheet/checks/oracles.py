"""The registered queries in plain SQL for DuckDB, over the same tables."""

from __future__ import annotations

from broadsheet.checks.queries import CAP, END, MATRIX_TERMS, SKIPPING, START, WORD
from broadsheet.functions.text import SPACE_CLASS
from broadsheet.functions.tokens import STOPWORDS

SPACE = SPACE_CLASS
TRIM = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160)"

ARTICLES = """
articles AS (
    SELECT CAST(doc_id AS BIGINT) AS full_article_id,
           CAST(doc_id AS VARCHAR) AS article_id,
           CASE WHEN doc_id % 97 = 0 THEN NULL ELSE source END AS lccn,
           CAST(DATE '1900-01-01' + CAST(doc_id * 37 % 365 * 3 AS INTEGER) AS VARCHAR) AS date,
           concat('p', CAST(1 + doc_id % 8 AS VARCHAR)) AS page,
           text AS article,
           concat('https://example.org/', source, '/', CAST(doc_id AS VARCHAR), '/seq-1.jp2') AS url,
           concat(source, '_', CAST(doc_id AS VARCHAR), '.json') AS filename,
           concat('The ', source, ' paper') AS newspaper_name
    FROM documents
)"""

SUPPLIERS = """
suppliers AS (
    SELECT *, concat('src', CAST(s_suppkey AS VARCHAR)) AS SN,
           concat('The src', CAST(s_suppkey AS VARCHAR), ' paper') AS Title
    FROM supplier
)"""

LOCATIONS = (
    SUPPLIERS
    + """,
locations AS (
    SELECT SN, Title, n_name AS City, r_name AS State,
           CASE WHEN s_nationkey <> 7 THEN
               -120 + CAST((CASE WHEN s_suppkey = 4 THEN 3 ELSE s_suppkey END) % 100 AS DOUBLE) / 2
           END AS Long,
           25 + CAST((CASE WHEN s_suppkey = 4 THEN 3 ELSE s_suppkey END) % 90 AS DOUBLE) / 4 AS Lat
    FROM suppliers JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE s_suppkey <> 19
)"""
)

TITLES = """
titles AS (
    SELECT SN, CASE WHEN s_acctbal < 5000 THEN concat(Title, ' (new)') ELSE Title END AS Title
    FROM suppliers
)"""

PLACED = (
    ARTICLES
    + ","
    + LOCATIONS
    + """,
placed AS (
    SELECT a.full_article_id, a.article_id, a.lccn, a.date, a.page, a.article, a.url, a.filename,
           coalesce(l.Title, a.newspaper_name) AS Title, l.City, l.State, l.Long, l.Lat
    FROM articles a LEFT JOIN locations l ON a.lccn = l.SN
)"""
)

POINTS = (
    PLACED
    + """,
located AS (
    SELECT * REPLACE (CASE full_article_id % 6
               WHEN 1 THEN replace(date, '-', '/') WHEN 2 THEN replace(date, '-', '.')
               WHEN 3 THEN replace(date, '-', '') WHEN 4 THEN concat(date, 'T00:00:00Z')
               WHEN 5 THEN concat('about ', date) ELSE date END AS date),
           CASE WHEN full_article_id % 6 <> 5 THEN CAST(date AS DATE) END AS day,
           CASE WHEN full_article_id % 6 = 5 THEN concat('about ', date) ELSE date END AS shown
    FROM placed
),
points AS (
    SELECT * EXCLUDE (Long, Lat), Lat AS lat, Long AS lon FROM located
    WHERE Lat IS NOT NULL AND Long IS NOT NULL
)"""
)

GROUPS = """
groups AS (
    SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, count(*) AS article_count,
           count(DISTINCT page) AS page_count,
           CAST(sum(len(regexp_extract_all(article, '(?i)tion'))) AS BIGINT) AS key_term_frequency,
           CAST(sum(len(regexp_extract_all(article, '[\\p{L}\\p{N}_]+'))) AS BIGINT) AS word_count
    FROM points GROUP BY 1, 2
)"""
GROUP_ID = "printf('group_%.6f_%.6f', lat, lon)"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _found(term: str, start: str = START, end: str = END, source: str = "articles") -> str:
    return f"""
found AS (
    SELECT *, CAST(substr(date, 1, 4) AS INTEGER) AS year FROM {source}
    WHERE date BETWEEN '{start}' AND '{end}' AND contains(lower(article), lower('{term}'))
)"""


def _tokens(drop: bool = False) -> str:
    every = "list_transform(regexp_extract_all(article, '[A-Za-z0-9'']+'), lambda t: lower(t))"
    if not drop:
        return every
    return f"list_filter({every}, lambda t: NOT list_contains({_list(STOPWORDS)}, t))"


def _near(phrase: list[str], source: str = "articles", drop: bool = False) -> str:
    """CTEs ``hit_rows`` (rows with a hit) and ``near`` (one row per neighbour)."""
    n = len(phrase)
    return f"""
toks AS (SELECT *, {_tokens(drop)} AS t FROM {source} WHERE contains(lower(article), '{phrase[0]}')),
hit_rows AS (
    SELECT * FROM (
        SELECT *, list_filter(range(1, len(t) + 1),
                              lambda i: t[i] = '{phrase[0]}' AND t[i:i + {n - 1}] = {_list(phrase)}) AS hits
        FROM toks)
    WHERE len(hits) > 0
),
windows AS (
    SELECT * EXCLUDE (t, hits, article, st), len(t[greatest(st - 5, 1):st - 1]) AS n_left,
           list_concat(t[greatest(st - 5, 1):st - 1], t[st + {n}:st + {n + 4}]) AS w
    FROM (SELECT *, unnest(hits) AS st FROM hit_rows)
),
near AS (
    SELECT * FROM (
        SELECT * EXCLUDE (w, n_left), unnest(w) AS collocate_term,
               generate_subscripts(w, 1) - 1 - n_left AS rel
        FROM windows)
    WHERE NOT regexp_full_match(collocate_term, '[0-9]+')
)"""


_FULL_METRICS = """
SELECT collocate_term, count(*) AS frequency, count(DISTINCT page) AS page_count,
       min(date) AS first_date, max(date) AS last_date, count(DISTINCT article_id) AS article_count,
       round(count(DISTINCT article_id) / (SELECT greatest(1, count(*)) FROM hit_rows), 9)
           AS cooccurrence_rate,
       round(avg(rel), 9) AS mean_relative_position
FROM near GROUP BY collocate_term"""


def _edges(start: str, end: str, interval: str) -> str:
    """Edges, each stepped from the one before, and the bins between them."""
    return f"""
edges(e) AS (
    SELECT DATE '{start}' UNION ALL
    SELECT CAST(e + INTERVAL {interval} AS DATE) FROM edges WHERE e <= DATE '{end}'
),
bins AS (SELECT * FROM (SELECT e AS lo, lead(e) OVER (ORDER BY e) AS hi FROM edges) WHERE hi IS NOT NULL)"""


_BY_TIME = """
counts AS (
    SELECT CAST(lo AS VARCHAR) AS time_bin, collocate_term, count(*) AS frequency
    FROM near JOIN bins ON CAST(date AS DATE) >= lo AND CAST(date AS DATE) < hi GROUP BY 1, 2
),
by_time AS (
    SELECT *, row_number() OVER (PARTITION BY time_bin ORDER BY frequency DESC, collocate_term)
        AS ordinal_rank FROM counts
)"""


def _monthly() -> str:
    return ",".join((ARTICLES, _near(["tion"]), _edges("1900-01-01", "1902-12-31", "1 MONTH"), _BY_TIME))


def _esc(text: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                         ("''", "&#x27;"), ("{", "&#123;"), ("}", "&#125;")):
        text = f"replace({text}, '{char}', '{entity}')"
    return text


def _mark(text: str, term: str) -> str:
    """Hits are put between private-use characters, which outlast the escaping."""
    tagged = f"regexp_replace({text}, '(?i)({term})', chr(57344) || '\\1' || chr(57345), 'g')"
    return f"replace(replace({_esc(tagged)}, chr(57344), '<mark>'), chr(57345), '</mark>')"


def _flat(text: str) -> str:
    return f"trim(regexp_replace({text}, '[{SPACE}]+', ' ', 'g'), {TRIM})"


def _cut(text: str, limit: int) -> str:
    return (
        f"CASE WHEN length({text}) <= {limit} THEN {text} "
        f"ELSE concat(rtrim(left({text}, {limit}), {TRIM}), '…') END"
    )


def _context(term: str) -> str:
    """CTE ``snippets``: article_id with the text around the first hit."""
    n = len(term)
    return f"""
spots AS (
    SELECT article_id, article, strpos(lower(article), '{term}') AS pos FROM points
),
cores AS (
    SELECT article_id, pos, length(article) AS total,
           regexp_replace(trim(substr(article, greatest(pos - 60, 1),
               least(pos + {n - 1} + 60, length(article)) - greatest(pos - 60, 1) + 1), {TRIM}),
               '[{SPACE}]+', ' ', 'g') AS core
    FROM spots
),
snippets AS (
    SELECT article_id, CASE WHEN pos = 0 THEN '' ELSE
        concat(CASE WHEN pos - 60 > 1 THEN '…' ELSE '' END, core,
               CASE WHEN pos + {n - 1} + 60 < total THEN '…' ELSE '' END) END AS snippet
    FROM cores
)"""


def oracle_sql() -> dict[str, str]:
    found = f"WITH {ARTICLES},{_found('tion')}"
    result = "article_id, lccn, date, page, article, url, filename"
    near_phrase = f"WITH {ARTICLES},{_near(['of', 'the'])}"
    near_word = f"WITH {ARTICLES},{_near(['tion'])}"
    years = "(SELECT CAST(range AS INTEGER) AS year FROM range(1899, 1904))"
    points = f"WITH {POINTS}"
    groups = f"WITH {POINTS},{GROUPS}"
    monthly = f"WITH RECURSIVE {_monthly()}"
    metrics = f"{near_word}, metrics AS (SELECT collocate_term, count(*) AS frequency FROM near GROUP BY 1), ranked AS (SELECT *, row_number() OVER (ORDER BY frequency DESC, collocate_term) AS rank FROM metrics)"
    candidates = f"""{metrics}, selected AS (SELECT unnest(['the', 'ouand', 'zzz-absent']) AS term),
candidates AS (
    SELECT coalesce(collocate_term, term) AS collocate_term, frequency, rank, term IS NOT NULL AS selected
    FROM (SELECT * FROM ranked WHERE rank <= 150 OR collocate_term IN (SELECT term FROM selected))
    FULL JOIN selected ON collocate_term = term
)"""
    located_rows = """
        SELECT article_id, lccn, date, page, article, url, filename, Title, City, State, Long, Lat FROM placed"""
    values = "SELECT round(lat, 6) AS glat, round(lon, 6) AS glon, CAST(count(*) AS DOUBLE) AS value FROM points GROUP BY 1, 2"
    frame_bounds = "(SELECT min(day) FROM points)", "(SELECT max(day) FROM points)"

    def frames(interval: str) -> str:
        return f"""
frame_days(e) AS (
    SELECT {frame_bounds[0]} UNION ALL
    SELECT CAST(e + INTERVAL {interval} AS DATE) FROM frame_days
    WHERE CAST(e + INTERVAL {interval} AS DATE) <= {frame_bounds[1]}
),
frames AS (SELECT CAST(row_number() OVER (ORDER BY e) - 1 AS INTEGER) AS frame_no, e AS frame_time FROM frame_days),
entered AS (
    SELECT p.lat, p.lon, p.day, v.value,
           coalesce((SELECT min(frame_no) FROM frames f WHERE f.frame_time >= p.day),
                    (SELECT max(frame_no) FROM frames)) AS entry
    FROM points p JOIN ({values}) v ON round(p.lat, 6) = v.glat AND round(p.lon, 6) = v.glon
    WHERE p.day IS NOT NULL
)"""

    sql = {
        "search_keyword": f"{found} SELECT {result}, year FROM found",
        "search_symbol": f"WITH {ARTICLES},{_found('%')} SELECT article_id, date FROM found",
        "search_clean": f"""WITH {ARTICLES}, broken AS (
                SELECT * REPLACE (replace(article, ', ', concat('- ', chr(10))) AS article,
                                  concat(upper(url), '?size=.jp2x') AS url) FROM articles),
            {_found('tion', source='broken')}
            SELECT article_id, date, lower(regexp_replace(article, '-[{SPACE}]+', '', 'g')) AS article,
                   regexp_replace(url, '(?i)\\.jp2([?#]|$)', '.pdf\\1', 'g') AS url FROM found""",
        "search_titles": f"""WITH {ARTICLES},{SUPPLIERS},{TITLES},{_found('tion')}
            SELECT article_id, lccn, titles.Title AS newspaper_name
            FROM found LEFT JOIN titles ON lccn = SN""",
        "search_cap_per_year": f"""{found}
            SELECT article_id, date, year FROM found
            QUALIFY row_number() OVER (PARTITION BY year ORDER BY date, article_id) <= {CAP}""",
        "search_counts_by_year": f"""WITH {ARTICLES},{_found('tion', '1899-01-01', '1903-12-31')}
            SELECT year, CAST(sum(n) AS BIGINT) AS match_count, count(*) AS years_searched FROM (
                SELECT y.year, count(f.article_id) AS n FROM {years} y LEFT JOIN found f ON y.year = f.year
                GROUP BY y.year)
            GROUP BY ROLLUP (year)""",
        "corpus_years_read": f"""WITH {ARTICLES}
            SELECT CAST(substr(date, 1, 4) AS INTEGER) AS year, count(*) AS articles,
                   count(DISTINCT lccn) AS newspapers
            FROM articles WHERE date >= '1901' AND date < '1903' GROUP BY 1""",
        "corpus_year_ranges": """
            SELECT min(year) AS first_year, max(year) AS last_year,
                   CASE WHEN min(year) = max(year) THEN CAST(min(year) AS VARCHAR)
                        ELSE concat(CAST(min(year) AS VARCHAR), '-', CAST(max(year) AS VARCHAR)) END AS label
            FROM (SELECT year, year - row_number() OVER (ORDER BY year) AS island
                  FROM (SELECT DISTINCT CAST(1700 + n_chars % 300 AS INTEGER) AS year FROM documents))
            GROUP BY island""",
        "run_metadata": f"""WITH {ARTICLES}, runs AS (
                SELECT lccn, page, min(date) AS lo, max(date) AS hi FROM articles
                GROUP BY lccn, page, substr(date, 1, 4)),
            facts AS (
                SELECT concat(CASE WHEN page < 'p4' THEN 'merged_' ELSE '' END,
                              concat_ws('_', lccn, page, lo, hi), '.json') AS file_name,
                       CASE WHEN page > 'p5' THEN concat('of ', page)
                            ELSE concat_ws('_', lccn, page) END AS search_term,
                       lo AS start_date, hi AS end_date
                FROM runs)
            SELECT *, left(sha1(concat('{{"end_date":"', end_date, '","search_term":"', search_term,
                                       '","start_date":"', start_date, '"}}')), 8) AS run_id
            FROM facts""",
        "payload_roundtrip": f"""WITH {ARTICLES},{SUPPLIERS},{TITLES},{_found('tion')}
            SELECT {result}, titles.Title AS newspaper_name FROM found LEFT JOIN titles ON lccn = SN""",
        "payload_manifest": f"""WITH {ARTICLES},{_found('tion', '1899-01-01', '1903-12-31')}
            SELECT 'tion' AS search_term, '1899-01-01' AS start_date, '1903-12-31' AS end_date,
                   y.year, count(f.article_id) AS match_count
            FROM {years} y LEFT JOIN found f ON y.year = f.year GROUP BY y.year""",
        "token_counts": f"""WITH {ARTICLES}, words AS (SELECT unnest({_tokens()}) AS token FROM articles)
            SELECT token, count(*) AS n FROM words
            WHERE NOT regexp_full_match(token, '[0-9]+') GROUP BY token""",
        "phrase_hits": f"{near_phrase} SELECT article_id, unnest(hits) - 1 AS position FROM hit_rows",
        "colloc_metrics": near_phrase + _FULL_METRICS,
        "colloc_metrics_word": near_word + _FULL_METRICS,
        "colloc_metrics_stopwords": f"""WITH {ARTICLES},{_near(['tion'], drop=True)}
            SELECT collocate_term, count(*) AS frequency, count(DISTINCT article_id) AS article_count,
                   round(count(DISTINCT article_id) / (SELECT count(*) FROM hit_rows), 9) AS cooccurrence_rate,
                   round(avg(rel), 9) AS mean_relative_position
            FROM near GROUP BY collocate_term""",
        "colloc_metrics_stopword_phrase": f"""WITH {ARTICLES},{_near(['attion', 'thanedble'], drop=True)}
            SELECT collocate_term, count(*) AS frequency, count(DISTINCT page) AS page_count
            FROM near GROUP BY collocate_term""",
        "colloc_dropped_terms": f"""{near_word}
            SELECT collocate_term, count(*) AS frequency FROM near GROUP BY collocate_term HAVING count(*) % 2 = 0
            UNION ALL SELECT NULL, 0""",
        "colloc_one_year": f"""WITH {ARTICLES},{_found('tion')}, chosen AS (
                SELECT * FROM found WHERE date BETWEEN '1901-02-01' AND '1901-11-30'),
            {_near(['tion'], source='chosen')}
            SELECT collocate_term, count(*) AS frequency FROM near GROUP BY collocate_term""",
        "metrics_preview": f"""{near_word}
            SELECT collocate_term, count(*) AS frequency FROM near GROUP BY collocate_term
            ORDER BY collocate_term LIMIT 30""",
        "metrics_read_back": f"""{near_word}
            SELECT collocate_term, count(*) AS frequency FROM near GROUP BY collocate_term""",
        "colloc_metrics_dropped": f"""{near_phrase}
            SELECT collocate_term, count(*) AS frequency FROM near
            WHERE collocate_term NOT IN ('the', 'in', 'and', 'zzz') GROUP BY collocate_term""",
        "colloc_filtered_place": f"""WITH {PLACED}, chosen AS (
                SELECT * FROM placed WHERE date BETWEEN '{START}' AND '{END}'
                AND lower(City) = 'nation_8' AND lower(State) = 'europe'),
            {_near(['the'], source='chosen')}
            SELECT collocate_term, count(*) AS frequency, count(DISTINCT page) AS page_count
            FROM near GROUP BY collocate_term""",
        "colloc_by_month": f"""WITH RECURSIVE {ARTICLES},{_near(['tion'])},
            {_edges('1900-01-31', '1902-12-31', '1 MONTH')},{_BY_TIME} SELECT * FROM by_time""",
        "colloc_by_2weeks": f"""WITH RECURSIVE {ARTICLES}, chosen AS (
                SELECT * FROM articles WHERE date BETWEEN '{START}' AND '{END}'),
            {_near(['of', 'the'], source='chosen')},
            {_edges(START, END, '14 DAY')},{_BY_TIME} SELECT * FROM by_time""",
        "colloc_by_year": f"""WITH RECURSIVE {ARTICLES},{_near(['tion'], drop=True)},
            edges(e) AS (SELECT CAST(min(date) AS DATE) FROM articles UNION ALL
                SELECT CAST(e + INTERVAL 1 YEAR AS DATE) FROM edges
                WHERE e <= (SELECT CAST(max(date) AS DATE) FROM articles)),
            bins AS (SELECT * FROM (SELECT e AS lo, lead(e) OVER (ORDER BY e) AS hi FROM edges)
                     WHERE hi IS NOT NULL),{_BY_TIME} SELECT * FROM by_time""",
        "occurrences": f"""WITH {POINTS},{_near(['of', 'the'], source='located')}
            SELECT article_id, lccn, date, Title, City, State, Long, Lat FROM hit_rows
            WHERE day IS NULL OR day BETWEEN DATE '{START}' AND DATE '{END}'""",
        "occurrence_features": f"""WITH {PLACED},{_near(['of', 'the'], source='placed')}
            SELECT article_id, date, page, Title, State, article, url, CASE WHEN Lat IS NOT NULL THEN Long END AS Long,
                   CASE WHEN Long IS NOT NULL THEN Lat END AS Lat
            FROM hit_rows WHERE date <= '{END}' AND lower(City) = 'nation_8'""",
        "occurrence_features_untouched": """SELECT concat('{"type":"Feature","id":', doc_id,
                ',"geometry":{"type":"LineString","coordinates":[[1,2],[3,4.50]]},"properties":{"City":"Rome","list":[1,{"a":2}],"n":',
                doc_id, '.0,"article":"some of the few"}}') AS line FROM documents WHERE doc_id % 3 = 0""",
        "collocation_tables": f"""WITH RECURSIVE {PLACED}, chosen AS (
                SELECT * FROM placed WHERE date BETWEEN '{START}' AND '{END}' AND lower(City) = 'nation_8'),
            {_near(['of', 'the'], source='chosen')},
            {_edges(START, END, '3 MONTH')},{_BY_TIME}
            SELECT * FROM by_time WHERE collocate_term NOT IN ('the', 'in', 'and', 'zzz')""",
        "top_collocates": f"{metrics} SELECT collocate_term, frequency FROM ranked WHERE rank <= 20",
        "rank_home_bin": f"""{monthly}, top AS (
                SELECT collocate_term, row_number() OVER (ORDER BY ordinal_rank) AS term_order FROM by_time
                WHERE time_bin = (SELECT time_bin FROM (SELECT DISTINCT time_bin FROM by_time)
                                  ORDER BY 1 LIMIT 1 OFFSET 1) AND ordinal_rank <= 10)
            SELECT time_bin, collocate_term, frequency, ordinal_rank, CAST(term_order AS INTEGER) AS term_order
            FROM by_time JOIN top USING (collocate_term)""",
        "rank_global": f"""{monthly}, means AS (
                SELECT collocate_term, avg(ordinal_rank) AS m FROM by_time GROUP BY 1),
            top AS (SELECT *, row_number() OVER (ORDER BY m, collocate_term) AS term_order FROM means
                    QUALIFY term_order <= 10)
            SELECT collocate_term, time_bin, frequency, ordinal_rank, CAST(term_order AS INTEGER) AS term_order,
                   round(m, 9) AS mean_rank
            FROM by_time JOIN top USING (collocate_term)""",
        "rank_matrix": f"""{monthly} SELECT time_bin, {', '.join(
                f'''min(CASE WHEN collocate_term = '{t}' THEN ordinal_rank END) AS "{t}"''' for t in MATRIX_TERMS)}
            FROM by_time GROUP BY time_bin""",
        "drop_candidates": f"{candidates} SELECT * FROM candidates",
        "drop_candidates_searched": f"""{candidates} SELECT * FROM candidates
            WHERE contains(lower(collocate_term), 'th') AND length(collocate_term) <= 5""",
        "metrics_ranked": f"{metrics} SELECT * FROM ranked",
        "locate_articles": f"WITH {PLACED} {located_rows}",
        "locate_by_title": f"""WITH {ARTICLES},{LOCATIONS}
            SELECT article_id, coalesce(Title, newspaper_name) AS Title, City, State, Long, Lat
            FROM articles LEFT JOIN locations ON newspaper_name = Title""",
        "locate_runs": f"""WITH {ARTICLES},{LOCATIONS}
            SELECT article_id, page,
                   coalesce(Title, CASE WHEN page <= 'p6' THEN newspaper_name END) AS Title, City, Long
            FROM articles LEFT JOIN locations
              ON (page <= 'p3' AND lccn = SN) OR (page > 'p3' AND page <= 'p6' AND newspaper_name = Title)""",
        "missing_coordinates": f"WITH {LOCATIONS} SELECT SN, Title FROM locations WHERE Long IS NULL OR Lat IS NULL",
        "apply_coordinates": f"""WITH {LOCATIONS}, fetched AS (
                SELECT SN, CASE WHEN s_nationkey = 7 THEN 37.75 + CAST(s_suppkey % 8 AS DOUBLE) / 4 END AS Lat,
                       CASE WHEN s_nationkey = 7 THEN -77.5 - CAST(s_suppkey % 8 AS DOUBLE) / 4 END AS Long
                FROM suppliers WHERE s_nationkey = 7 OR s_acctbal < 1000)
            SELECT l.SN, l.Title, l.City, l.State,
                   CASE WHEN f.SN IS NOT NULL THEN f.Long ELSE l.Long END AS Long,
                   CASE WHEN f.SN IS NOT NULL THEN f.Lat ELSE l.Lat END AS Lat
            FROM locations l LEFT JOIN fetched f ON l.SN = f.SN""",
        "locations_csv": f"WITH {LOCATIONS} SELECT SN, Title, City, State, Long, Lat FROM locations",
        "titles_csv": f"WITH {SUPPLIERS},{TITLES} SELECT SN, Title FROM titles",
        "titles_csv_files": f"WITH {SUPPLIERS},{TITLES} SELECT SN, Title FROM titles",
        "locations_last_rows": f"""WITH {LOCATIONS} SELECT SN, CASE WHEN SN LIKE '%1' THEN concat(Title, ' again') ELSE Title END AS Title
            FROM locations WHERE Long IS NULL OR Lat IS NULL""",
        "coordinates_updated": f"""WITH {LOCATIONS}
            SELECT SN, Title, City, State, -77.5 - CAST(s_suppkey % 8 AS DOUBLE) / 4 AS Long,
                   37.75 + CAST(s_suppkey % 8 AS DOUBLE) / 4 AS Lat
            FROM locations JOIN (SELECT SN, s_suppkey FROM suppliers WHERE s_nationkey = 7) USING (SN)""",
        "features_roundtrip": f"""WITH {PLACED}
            SELECT {result}, Title, City, State, Lat AS lat, Long AS lon, date AS day FROM placed
            WHERE Lat IS NOT NULL AND Long IS NOT NULL""",
        "place_facets": f"""WITH {PLACED}
            SELECT DISTINCT 'City' AS facet, City AS value FROM placed WHERE City <> '' UNION ALL
            SELECT DISTINCT 'State' AS facet, State AS value FROM placed WHERE State <> ''""",
        "join_stats": f"WITH {PLACED} SELECT count(DISTINCT Title) AS places, count(*) AS articles FROM placed",
        "map_groups": f"""{groups} SELECT {GROUP_ID} AS group_id, *, CAST(article_count AS DOUBLE) AS value
            FROM groups""",
        "map_groups_norm": f"""{groups} SELECT {GROUP_ID} AS group_id,
                round(key_term_frequency / word_count, 9) AS value,
                format('{{:,}}', word_count) AS words FROM groups""",
        "map_groups_no_hit": f"""{groups} SELECT {GROUP_ID} AS group_id, CAST(0 AS BIGINT) AS key_term_frequency,
                CAST(1 AS DOUBLE) AS value, CAST(28 AS DOUBLE) AS radius FROM groups""",
        "map_summary": f"""{points} SELECT count(*) AS articles, count(DISTINCT lccn) AS newspapers,
                count(DISTINCT City) AS cities, CAST(min(day) AS VARCHAR) AS start_date,
                '1903-01-01' AS end_date FROM points""",
        "map_radii": f"""{groups}, spread AS (SELECT min(key_term_frequency) AS lo, max(key_term_frequency) AS hi FROM groups)
            SELECT {GROUP_ID} AS group_id, article_count, CAST(key_term_frequency AS DOUBLE) AS value,
                   round(4 + CAST(key_term_frequency - lo AS DOUBLE) / (hi - lo) * 26, 9) AS graduated,
                   CAST(CASE WHEN article_count > 1 THEN 5 ELSE 3 END AS DOUBLE) AS plain
            FROM groups, spread""",
        "heat_static": f"""{points} SELECT p.lat, p.lon, v.value * 2.5 AS weight
            FROM points p JOIN ({values}) v ON round(p.lat, 6) = v.glat AND round(p.lon, 6) = v.glon""",
        "heat_frames": f"""WITH RECURSIVE {POINTS},{frames('1 MONTH')}
            SELECT f.frame_no, f.frame_time, e.lat, e.lon, e.value AS weight
            FROM entered e JOIN frames f
              ON f.frame_no >= e.entry AND f.frame_time < e.day + INTERVAL 42 DAY""",
        "heat_frames_places": f"""WITH RECURSIVE {POINTS},{frames('14 DAY')}
            SELECT f.frame_no, f.frame_time, e.lat, e.lon, sum(e.value * 0.5) AS weight, count(*) AS points
            FROM entered e JOIN frames f ON f.frame_no = e.entry GROUP BY ALL""",
        "map_clusters": f"""{groups} SELECT *,
                CASE WHEN abs(metric_sum) >= 100 THEN 'large' WHEN abs(metric_sum) >= 10 THEN 'medium'
                     ELSE 'small' END AS size_class,
                format('{{:,}}', CAST(metric_sum AS BIGINT)) AS label
            FROM (SELECT CAST(floor((lon + 180) / 3.515625) AS BIGINT) AS cell_x,
                         CAST(floor((lat + 90) / 3.515625) AS BIGINT) AS cell_y,
                         CAST(sum(article_count) AS DOUBLE) AS metric_sum, count(*) AS locations,
                         CAST(sum(article_count) AS BIGINT) AS articles
                  FROM groups GROUP BY 1, 2)""",
        "map_clusters_levels": f"""{groups} SELECT *,
                CASE WHEN abs(metric_sum) >= 100 THEN 'large' WHEN abs(metric_sum) >= 10 THEN 'medium'
                     ELSE 'small' END AS size_class,
                format('{{:,}}', CAST(metric_sum AS BIGINT)) AS label
            FROM (SELECT CAST(zoom AS INTEGER) AS zoom,
                         CAST(floor((lon + 180) * 2 ** zoom / 112.5) AS BIGINT) AS cell_x,
                         CAST(floor((lat + 90) * 2 ** zoom / 112.5) AS BIGINT) AS cell_y,
                         CAST(sum(article_count) AS DOUBLE) AS metric_sum, count(*) AS locations,
                         CAST(sum(article_count) AS BIGINT) AS articles
                  FROM groups, range(9) levels(zoom) GROUP BY 1, 2, 3)""",
        "map_entries": f"""{points},{_context('tion')}, shaped AS (
                SELECT *, concat_ws(', ', City, State) AS place_name,
                       trim(regexp_extract(article, '^[^\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]*'), {TRIM}) AS head
                FROM points JOIN snippets USING (article_id))
            SELECT {GROUP_ID} AS group_id, article_id,
                   concat_ws(' — ', shown, Title, place_name) AS label,
                   {_esc("CASE WHEN length(head) <= 160 THEN head ELSE concat(rtrim(left(head, 159), " + TRIM + "), '…') END")}
                       AS first_line,
                   {_mark('snippet', 'tion')} AS context,
                   replace(url, '.jp2', '.pdf') AS pdf_url, shown AS date, {_esc('Title')} AS newspaper,
                   {_esc('place_name')} AS place, page
            FROM shaped""",
        "map_entry_details": f"""{points},{_context('amp')}, flat AS (
                SELECT article_id, snippet, {_flat('article')} AS whole FROM points JOIN snippets USING (article_id)),
            cut AS (SELECT article_id, snippet, {_cut('whole', 1200)} AS excerpt FROM flat)
            SELECT article_id, {_mark('snippet', 'amp')} AS context, {_mark('excerpt', 'amp')} AS details
            FROM cut""",
        "map_titles": f"""{points} SELECT {GROUP_ID} AS group_id,
                concat('Articles mentioning "tion" in ', arg_min(City, article_id)) AS title,
                count(*) AS article_count
            FROM points GROUP BY lat, lon""",
        "attribute_table": f"""{points}, flat AS (SELECT *, {_flat('article')} AS whole FROM points)
            SELECT printf('%.6f', lat) AS Latitude, printf('%.6f', lon) AS Longitude, date, Title,
                   {_cut('whole', 420)} AS article, url FROM flat""",
        "attribute_table_minimal": f"""{points} SELECT printf('%.6f', lat) AS Latitude,
                printf('%.6f', lon) AS Longitude, date, Title, City, State, coalesce(lccn, '') AS lccn, page, url
            FROM points ORDER BY day NULLS FIRST, article_id LIMIT 300""",
        "attribute_table_open": f"""{points}, listed AS (
                SELECT article_id, lat, lon, unnest(['article_id', 'Title', 'page', 'State', 'Page']) AS property,
                       unnest([article_id, Title, page, State, date]) AS value FROM points)
            SELECT article_id, printf('%.6f', lat) AS Latitude, printf('%.6f', lon) AS Longitude, property, value
            FROM listed WHERE value IS NOT NULL""",
        "attribute_table_mixed_case": f"""{points} SELECT printf('%.6f', lat) AS Latitude,
                printf('%.6f', lon) AS Longitude, article_id, page, date AS Page_, Title AS headline FROM points""",
        "attribute_table_lightweight": f"""{points} SELECT printf('%.6f', lat) AS Latitude,
                printf('%.6f', lon) AS Longitude, date, Title, '' AS headline, City, State, page, url FROM points""",
        "stream_search": f"{found} SELECT article_id, date, page, url, year FROM found",
        "stream_search_cap": f"""{found}
            SELECT year, least(count(*), {CAP}) AS kept FROM found GROUP BY year""",
        "stream_search_early_stop": f"""WITH {ARTICLES} SELECT CAST(substr(date, 1, 4) AS INTEGER) AS year, 1::BIGINT AS kept
            FROM articles WHERE date BETWEEN '{START}' AND '{END}' GROUP BY 1""",
        "stream_progress": f"""WITH {ARTICLES}, hits AS (
                SELECT article_id FROM articles WHERE date BETWEEN '{START}' AND '{END}' AND contains(lower(article), '{WORD}'))
            SELECT CAST(substr(date, 1, 4) AS INTEGER) AS year, count(*) AS read,
                   count(*) FILTER (article_id IN (SELECT article_id FROM hits)) AS matched
            FROM articles WHERE substr(date, 1, 4) BETWEEN '{START[:4]}' AND '{END[:4]}' GROUP BY 1""",
        "collection_roundtrip": f"""WITH {ARTICLES}
            SELECT full_article_id AS id, full_article_id / 4 AS score, CAST(to_json([page, lccn]) AS VARCHAR) AS places, 'true' AS sure,
                   full_article_id / 8 AS lat, article_id, 'urn:x' AS crs FROM articles""",
        "search_skipping": " UNION ALL ".join(
            f"""SELECT '{term}' AS term, article_id, date, article, CAST(substr(date, 1, 4) AS INTEGER) AS year FROM articles
                WHERE date BETWEEN '{START}' AND '{END}' AND contains(lower(article), '{term}')""" for term in SKIPPING
        ).replace("SELECT", f"WITH {ARTICLES} SELECT", 1),
    }
    return sql
