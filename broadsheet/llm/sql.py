"""Queries of this subpackage in SQL for DuckDB, where SQL can say the same."""

COLLOCATIONS = r"""WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang),
grams AS (
    SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, unnest(range(1, 6)) AS k FROM words) WHERE len(w) >= k)),
totals AS (SELECT lang, phrase, k AS words, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
    SELECT lang, phrase, f AS a, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS first, array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') AS rest
    FROM (SELECT *, unnest(range(1, words)) AS cut FROM totals WHERE words > 1)),
scores AS (
    SELECT c.lang, c.phrase, a, cut, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
    FROM cuts c JOIN totals x ON x.lang = c.lang AND x.phrase = c.first JOIN totals y ON y.lang = c.lang AND y.phrase = c.rest JOIN sizes s ON s.lang = c.lang),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
holders AS (
    SELECT lang, f, array_to_string(string_split(phrase, ' ')[s:s + m - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, words - m + 2)) AS s FROM (SELECT *, unnest(range(2, words)) AS m FROM totals WHERE words > 2))),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM holders h WHERE h.lang = b.lang AND h.phrase = b.phrase AND 100 * h.f >= 100 * b.a))
SELECT * FROM (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
           a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM kept)
WHERE rank <= 2000"""

HARD_NEGATIVES = """WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
anchors AS (SELECT * FROM rows WHERE vec_id % 50 = 0),
scores AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
    FROM anchors a JOIN rows r ON a.vec_id <> r.vec_id),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
negatives AS (
    SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS place
    FROM positives p JOIN scores s USING (anchor_id)
    WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, place::INT AS rank, negative_id, positive_score, negative_score FROM negatives WHERE place <= 3"""
