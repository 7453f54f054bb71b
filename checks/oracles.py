"""SQL, for DuckDB, that gives the same results as the queries of the same name."""

from __future__ import annotations

from lexivec.functions.stemming import IRREGULAR, KEPT_AFTER_PLURAL, STEP_2, STEP_3, STEP_4
from lexivec.functions.text import STOP_WORDS

DOCS = """
docs AS (
  SELECT doc_id, lang, source, split_part(text, chr(10), 1) AS name,
         CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS definition
  FROM documents)"""


def words(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '\p{{L}}+')"


STOP_LIST = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"


def content_tokens(text: str) -> str:
    """Runs of letters, without those of contractions in the stop list."""
    whole = rf"regexp_extract_all({text}, '\p{{L}}+(?:[''’]\p{{L}}+)*')"
    return (
        rf"flatten([regexp_extract_all(x, '\p{{L}}+') FOR x IN {whole}"
        rf" IF regexp_matches(x, '^\p{{L}}+$') OR NOT list_contains({STOP_LIST}, replace(x, '’', chr(39)))])"
    )


def content_words(text: str) -> str:
    return f"list_filter({content_tokens(f'lower({text})')}, lambda w: NOT list_contains({STOP_LIST}, w))"


def index_ctes(name: str = words("name"), definition: str = words("definition"), asked: str = words("text"), places: int = 4) -> str:
    """Term frequencies, lengths, statistics and weights of the documents, and the terms of the queries."""
    return f"""
{DOCS},
arrays AS (SELECT doc_id, {name} AS names, {definition} AS definitions FROM docs),
tokens AS (
  SELECT doc_id, 0 AS field, unnest(names) AS term FROM arrays
  UNION ALL SELECT doc_id, 1 AS field, unnest(definitions) AS term FROM arrays),
tf AS (
  SELECT doc_id, term, count(*) FILTER (field = 0) * 2e0 + count(*) FILTER (field = 1) * 1e0 AS freq
  FROM tokens GROUP BY doc_id, term),
lengths AS (SELECT doc_id, len(names) * 2e0 + len(definitions) * 1e0 AS length FROM arrays),
totals AS (
  SELECT count(*) AS documents, sum(length) AS total_length, sum(length) / count(*) AS mean_length FROM lengths),
stats AS (
  SELECT term, df, ln(((SELECT documents FROM totals) - df + 0.5e0) / (df + 0.5e0) + 1e0) AS idf
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term)),
weights AS (
  SELECT doc_id, term, CAST(floor(abs(raw) * 1e{places} + 0.5e0) AS BIGINT) AS units
  FROM (SELECT doc_id, term,
               abs(freq * 2.2e0 / (1.2e0 * (0.25e0 + 0.75e0 * (length / (SELECT mean_length FROM totals))) + freq)) * idf
                 AS raw
        FROM tf JOIN lengths USING (doc_id) JOIN stats USING (term))),
asked AS (
  SELECT query_id, term, count(*) AS times
  FROM (SELECT item_id AS query_id, unnest({asked}) AS term FROM benchmark) GROUP BY query_id, term),
hits AS (
  SELECT query_id, doc_id, CAST(sum(units * times) AS BIGINT) AS units
  FROM weights JOIN asked USING (term) GROUP BY query_id, doc_id)"""


RANKED = """
ranked AS (
  SELECT query_id, doc_id, units / 1e4 AS score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY units DESC, doc_id) AS INTEGER) AS rank
  FROM hits)"""


def with_index(select: str, **options) -> str:
    return f"WITH {index_ctes(**options)}, {RANKED} {select}"


# Every vector is a query, and every vector is in the corpus.
SIMS = """
vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sims AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_inner_product(c.v, q.v), 6) AS sim
  FROM vectors q, vectors c),
near AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS INTEGER) AS rank FROM sims)"""

TEXTS = f"""
{DOCS},
texts AS (SELECT doc_id AS id, name || chr(10) || chr(10) || definition AS text FROM docs)"""


def overlap_score(asked: str, given: str) -> str:
    asked_words = f"list_distinct({words(asked)})"
    return f"""(1e0 / (1e0 + exp(-(CASE WHEN len({asked_words}) = 0 THEN -4e0
        ELSE 8e0 * len(list_intersect({asked_words}, {words(given)})) / greatest(len({asked_words}), 1) - 4e0 END))))"""


def reranked(head: int, above: float | None = None, most: int | None = None, asked: str = "text") -> str:
    """The keyword queries with the vectors of the same number, their hits, and the first hits rescored."""
    floor = "" if above is None else f"AND sim > {above}"
    cut = "" if most is None else f"AND rank <= {most}"
    return f"""
{SIMS}, {TEXTS},
asked AS (SELECT item_id AS query_id, {asked} AS query FROM benchmark),
listed AS (SELECT near.* FROM near JOIN asked USING (query_id) WHERE true {floor} {cut}),
scored AS (
  SELECT query_id, id, {overlap_score("query", "text")} AS rerank_score
  FROM listed JOIN asked USING (query_id) JOIN texts USING (id)
  WHERE rank <= {head} AND trim(query) <> ''),
reordered AS (
  SELECT query_id, id, sim, rank AS first_rank, rerank_score,
         CAST(CASE WHEN rank > {head} THEN rank ELSE row_number() OVER (
           PARTITION BY query_id, rank > {head} ORDER BY rerank_score DESC NULLS LAST, rank) END AS INTEGER) AS rank
  FROM listed LEFT JOIN scored USING (query_id, id))"""


def compared(select: str, shown: int, limit: float) -> str:
    """A page of both rankings beside each other."""
    page = f"rank > {shown} AND rank <= {shown + 10}"
    return f"""
        WITH {SIMS}, {index_ctes()}, {RANKED},
        semantic AS (SELECT near.* FROM near WHERE {page} AND query_id IN (SELECT item_id FROM benchmark)),
        lexical AS (SELECT * FROM ranked WHERE {page}),
        compared AS (
          SELECT semantic.query_id, semantic.rank, semantic.id AS semantic_id, semantic.sim AS semantic_score,
                 lexical.doc_id AS lexical_id, lexical.score AS lexical_score, lexical.doc_id IS NOT NULL AS lexical_found,
                 semantic.sim < {limit} AS semantic_low
          FROM semantic LEFT JOIN lexical ON semantic.query_id = lexical.query_id AND semantic.rank = lexical.rank)
        {select}"""


NEIGHBOURS = """
pairs AS (
  SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""

PARTS = """
series AS (
  SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name,
         CASE WHEN p_size > 25 THEN p_type END AS long, CASE WHEN p_size > 10 THEN p_brand END AS short
  FROM part),
defined AS (SELECT code, name, coalesce(long, short) AS definition FROM series)"""


def letters(text: str) -> str:
    counts = f"[len({text}) - len(replace({text}, chr(CAST(c AS INTEGER)), '')) FOR c IN range(97, 123)]"
    return f"list_transform({counts}, lambda n: CAST(n AS DOUBLE))"


SORTED_WORDS = f"""
turns AS (SELECT conv_id, turn, {words("text")} AS words FROM conversations),
placed AS (SELECT conv_id, turn, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM turns)"""

CONVERSATIONS = f"""
pairs AS (
  SELECT q.conv_id AS query_id, r.turn AS corpus_id, q.text AS query, r.text
  FROM conversations q JOIN conversations r ON q.conv_id = r.conv_id WHERE q.turn = 0 AND r.turn > 0),
scored AS (SELECT query_id, corpus_id, text, {overlap_score("query", "text")} AS score FROM pairs),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS INTEGER) AS rank
  FROM scored)"""

MATRIX = """
guessed AS (
  SELECT doc_id, CASE WHEN n_chars < 100 THEN 'unknown' WHEN n_chars < 1500 THEN '0' WHEN n_chars < 9000 THEN '1'
                      ELSE '3' END AS guess
  FROM documents),
counted AS (
  SELECT guess, CAST(quality AS VARCHAR) AS truth, count(*) AS n FROM labels JOIN guessed USING (doc_id) GROUP BY ALL),
names AS (SELECT unnest(['0', '1', '2']) AS label),
matrix AS (
  SELECT a.label AS guess, b.label AS truth, coalesce(n, 0) AS n
  FROM names a CROSS JOIN names b LEFT JOIN counted ON counted.guess = a.label AND counted.truth = b.label)"""


def four_places(ratio: str) -> str:
    return f"coalesce(floor({ratio} * 1e4 + 0.5e0) / 1e4, 0e0)"


NEGATED = (
    r"""((?:^|[^\p{L}])(?:no|not|never|\p{L}+n[''’]t))([^\p{L}.,;:!?()\[\]{}"…—][^.,;:!?()\[\]{}"…—]*)"""
)

# The marked tokens of each text, as a list.
CUT = rf"""
cut AS (
  SELECT doc_id, string_split_regex(
           regexp_replace(lower(text), '{NEGATED}', '\1' || chr(1) || '\2' || chr(2), 'g'),
           '[' || chr(1) || chr(2) || ']') AS spans
  FROM documents)"""
MARKED = rf"""{CUT},
marked AS (
  SELECT doc_id, flatten(list_transform(spans, lambda s, i:
           CASE WHEN i % 2 = 0 THEN ['!' || w FOR w IN regexp_extract_all(s, '\p{{L}}+')]
                ELSE regexp_extract_all(s, '\p{{L}}+') END)) AS tokens
  FROM cut)"""


MARKED_CONTENT = f"""{CUT},
marked AS (
  SELECT doc_id, flatten(list_transform(spans, lambda s, i:
           CASE WHEN i % 2 = 0 THEN ['!' || w FOR w IN {content_tokens("s")}] ELSE {content_tokens("s")} END)) AS tokens
  FROM cut)"""


def by_suffix(table: dict[str, str], region: str, **conditions: str) -> str:
    """Replace the longest suffix of `w` that the table lists, if it lies in a region and its condition holds."""
    cases = []
    for tail in sorted(table, key=len, reverse=True):
        base = f"left(w, length(w) - {len(tail)})"
        holds = conditions.get(tail, "true").replace("BASE", base)
        cases.append(
            f"WHEN ends_with(w, '{tail}') THEN CASE WHEN length(w) - {len(tail)} >= {region} AND {holds}"
            f" THEN {base} || '{table[tail]}' ELSE w END"
        )
    return f"CASE {' '.join(cases)} ELSE w END"


PAIR = "^.*?[aeiouy][^aeiouy]"
SHORT = "(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def past_tense() -> str:
    cases = [
        f"WHEN ends_with(w, '{tail}') THEN CASE WHEN length(w) - {len(tail)} >= r1"
        f" THEN left(w, length(w) - {len(tail)}) || 'ee' ELSE w END"
        for tail in ("eedly", "eed")
    ]
    for tail in ("ingly", "edly", "ing", "ed"):
        base = f"left(w, length(w) - {len(tail)})"
        cases.insert(
            1 if tail in ("ingly", "edly") else len(cases),
            f"""WHEN ends_with(w, '{tail}') THEN CASE
                WHEN NOT regexp_matches({base}, '[aeiouy]') THEN w
                WHEN regexp_matches({base}, '(at|bl|iz)$') THEN {base} || 'e'
                WHEN regexp_matches({base}, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left({base}, length({base}) - 1)
                WHEN r1 >= length({base}) AND regexp_matches({base}, '{SHORT}') THEN {base} || 'e'
                ELSE {base} END""",
        )
    return f"CASE {' '.join(cases)} ELSE w END"


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# Porter2 over the distinct words, one step per table.
STEMS = f"""
given AS (SELECT DISTINCT ltrim(unnest(tokens), '!') AS word FROM marked),
w0 AS (
  SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM given
  WHERE length(word) > 2 AND word NOT IN ({quoted(IRREGULAR)})),
w1 AS (
  SELECT word, w, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)')
                       THEN length(regexp_extract(w, '^(gener|commun|arsen)'))
                       WHEN regexp_matches(w, '{PAIR}') THEN length(regexp_extract(w, '{PAIR}'))
                       ELSE length(w) END AS r1 FROM w0),
w2 AS (
  SELECT word, w, r1, CASE WHEN regexp_matches(substr(w, r1 + 1), '{PAIR}')
                           THEN r1 + length(regexp_extract(substr(w, r1 + 1), '{PAIR}')) ELSE length(w) END AS r2 FROM w1),
plural AS (
  SELECT word, r1, r2, CASE WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2)
                            WHEN regexp_matches(w, 'ie[ds]$') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
                            WHEN regexp_matches(w, '[us]s$') THEN w
                            WHEN regexp_matches(w, '[aeiouy].+s$') THEN left(w, length(w) - 1)
                            ELSE w END AS w FROM w2),
past AS (
  SELECT word, r1, r2, CASE WHEN w IN ({quoted(sorted(KEPT_AFTER_PLURAL))}) THEN NULL ELSE {past_tense()} END AS w,
         w AS kept FROM plural),
final_y AS (SELECT word, r1, r2, kept, regexp_replace(w, '^(.*.[^aeiouy])[yY]$', '\\1i') AS w FROM past),
step2 AS (
  SELECT word, r1, r2, kept,
         {by_suffix({**STEP_2, "ogi": "og", "li": ""}, "r1", ogi="ends_with(BASE, 'l')", li="regexp_matches(BASE, '[cdeghkmnrt]$')")}
           AS w FROM final_y),
step3 AS (
  SELECT word, r1, r2, kept, {by_suffix({**STEP_3, "ative": ""}, "r1", ative="length(BASE) >= r2")} AS w FROM step2),
step4 AS (
  SELECT word, r1, r2, kept,
         {by_suffix({**dict.fromkeys(STEP_4, ""), "ion": ""}, "r2", ion="regexp_matches(BASE, '[st]$')")} AS w FROM step3),
step5 AS (
  SELECT word, kept, CASE
         WHEN ends_with(w, 'e') AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1
              AND NOT regexp_matches(left(w, length(w) - 1), '{SHORT}'))) THEN left(w, length(w) - 1)
         WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN left(w, length(w) - 1)
         ELSE w END AS w FROM step4),
stems AS (
  SELECT word, lower(coalesce(w, kept)) AS stem FROM step5
  UNION ALL SELECT word, word FROM given WHERE length(word) <= 2
  UNION ALL SELECT given.word, column1 FROM given
    JOIN (VALUES {", ".join(f"('{w}', '{s}')" for w, s in IRREGULAR.items())}) AS known(column0, column1)
      ON given.word = column0 WHERE length(given.word) > 2)"""

def default_prep() -> str:
    """Weighted frequency of each term after negation, stop words and stems, field by field."""
    fields = MARKED_CONTENT.replace("FROM documents", "FROM fields").replace("SELECT doc_id,", "SELECT doc_id, weight,")
    return f"""
        WITH {DOCS},
        fields AS (SELECT doc_id, 2e0 AS weight, name AS text FROM docs UNION ALL SELECT doc_id, 1e0, definition FROM docs),
        {fields}, {STEMS},
        placed AS (
          SELECT doc_id, weight, unnest(list_filter(tokens, lambda t: NOT list_contains({STOP_LIST}, ltrim(t, '!')))) AS token
          FROM marked)
        SELECT doc_id, CASE WHEN token LIKE '!%' THEN '!' ELSE '' END || stem AS term, sum(weight) AS freq
        FROM placed JOIN stems ON word = ltrim(token, '!') GROUP BY ALL"""


ORACLES: dict[str, str] = {
    "scan_series": f"""
        WITH {DOCS} SELECT CAST(doc_id AS VARCHAR) AS code, name, definition AS long, source AS short FROM docs""",
    "scan_embeddings": """
        SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos,
               round(CAST(unnest(embedding) AS DOUBLE), 6) AS value
        FROM embeddings""",
    "sink_corpus_roundtrip": f"""
        WITH {DOCS}
        SELECT CAST(doc_id AS VARCHAR) AS code, name, definition,
               array_to_string([CAST(round_even(CAST(v AS DOUBLE) * 1e6, 0) AS BIGINT) FOR v IN embedding], ',') AS units
        FROM docs LEFT JOIN embeddings ON doc_id = vec_id""",
    "scan_split_array": "SELECT doc_id, lang, n_chars, text FROM documents",
    "definition_lookup": f"WITH {DOCS} SELECT CAST(doc_id AS VARCHAR) AS code, definition FROM docs",
    "json_explode": """
        SELECT event_id, unnest(json_keys(props)) AS name,
               unnest([json_extract_string(props, k) FOR k IN json_keys(props)]) AS value
        FROM events""",
    "index_roundtrip": with_index("SELECT * FROM ranked WHERE rank <= 10"),
    "coalesce_definition": f"WITH {PARTS} SELECT code, definition FROM defined",
    "compose_text": f"WITH {PARTS} SELECT code, name || chr(10) || chr(10) || definition AS text FROM defined",
    "rename_select": f"WITH {PARTS} SELECT code, name, definition FROM defined",
    "extend_record": """
        SELECT c_custkey, upper(c_mktsegment) AS c_name, c_nationkey, c_acctbal, c_mktsegment,
               c_acctbal < 0 AS debt, false AS shown
        FROM customer""",
    "embed_text": f"""
        WITH counts AS (SELECT doc_id, {letters("lower(text)")} AS n FROM documents),
        norms AS (SELECT doc_id, n, sqrt(list_inner_product(n, n)) AS norm FROM counts)
        SELECT doc_id, CAST(generate_subscripts(n, 1) - 1 AS INTEGER) AS pos,
               round(CASE WHEN norm > 0 THEN unnest(n) / norm ELSE 0e0 END, 6) AS value
        FROM norms""",
    "link_columns": """
        SELECT code, 'https://data.worldbank.org/indicator/' || code AS page_url,
               'https://api.worldbank.org/v2/sources/2/series/' || code || '/metadata?format=json' AS metadata_url,
               'https://data.worldbank.org/share/widget?indicators=' || code || '&locations=1W&start=1984&view=chart'
                 AS chart_url
        FROM (SELECT CAST(p_partkey AS VARCHAR) AS code FROM part)""",
    "score_round": "SELECT event_id, round(value / 7, 2) AS score FROM events",
    "vec_dot": f"WITH {NEIGHBOURS} SELECT vec_id, round(list_inner_product(x, y), 6) AS value FROM pairs",
    "vec_dot_accessor": f"""
        WITH {NEIGHBOURS}
        SELECT vec_id, round(list_inner_product(list_transform(x, lambda v, i: v * i), y), 6) AS value FROM pairs""",
    "vec_l2norm": """
        SELECT vec_id, round(sqrt(list_sum([(CAST(v AS DOUBLE) * 3) ** 2 FOR v IN embedding])), 6) AS value
        FROM embeddings""",
    "vec_l2norm_accessor": """
        SELECT vec_id,
               round(sqrt(list_sum(list_transform(embedding, lambda v, i: (CAST(v AS DOUBLE) * i) ** 2))), 6) AS value
        FROM embeddings""",
    "vec_cosine": f"""
        WITH {NEIGHBOURS}
        SELECT vec_id, round(list_cosine_similarity(list_transform(x, lambda v, i: v * i), y), 6) AS value FROM pairs""",
    "sigmoid_score": "SELECT event_id, round(1 / (1 + exp(-((value - 50) / 25))), 9) AS score FROM events",
    "embedding_parity": """
        SELECT count(*) AS pairs, round(min(sim), 6) AS min_sim, count(*) FILTER (sim <= 0.99) AS failed
        FROM (SELECT list_inner_product(CAST(embedding AS DOUBLE[]),
                       [round_even(CAST(v AS DOUBLE) * 20, 0) / 20 FOR v IN embedding]) AS sim
              FROM embeddings)""",
    "vector_topk": """
        SELECT vec_id, label, sim
        FROM (SELECT vec_id, label, round(list_inner_product(CAST(embedding AS DOUBLE[]),
                       [CASE WHEN i % 2 = 0 THEN 0.125e0 ELSE -0.125e0 END FOR i IN range(64)]), 6) AS sim
              FROM embeddings)
        ORDER BY sim DESC, vec_id LIMIT 5""",
    "vector_topk_batch": f"WITH {SIMS} SELECT * FROM near WHERE rank <= 5",
    "vector_topk_grid": f"WITH {SIMS} SELECT * FROM near WHERE rank <= 5",
    "sim_threshold": f"WITH {SIMS} SELECT * FROM sims WHERE sim > 0.25",
    "keyword_contains": f"WITH {DOCS} SELECT doc_id FROM docs WHERE contains(lower(definition), 'the a')",
    "bm25_filtered": f"""
        WITH {index_ctes()},
        kept AS (SELECT hits.* FROM hits JOIN docs USING (doc_id) WHERE lang = 'es' OR source = 'src7')
        SELECT * FROM (
          SELECT query_id, doc_id, units / 1e4 AS score,
                 CAST(row_number() OVER (PARTITION BY query_id ORDER BY units DESC, doc_id) AS INTEGER) AS rank
          FROM kept)
        WHERE rank <= 10""",
    "rerank_blank_query": f"""
        WITH {reranked(20, most=30, asked="CASE WHEN contains(text, 'the') THEN text ELSE '  ' END")}
        SELECT query_id, id, sim, first_rank, round(rerank_score, 9) AS rerank_score, rank FROM reordered""",
    "low_confidence": f"""
        WITH {reranked(10, most=30)}
        SELECT query_id, id, rank, CASE WHEN rerank_score IS NOT NULL THEN rerank_score < 0.15 ELSE sim < 0.3 END AS low
        FROM reordered""",
    "finite_filter": """
        SELECT event_id, value, value = floor(value) AS whole
        FROM events WHERE event_type NOT IN ('error', 'signup')""",
    "duplicate_ids": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1",
    "bm25_term_freq": f"WITH {index_ctes()} SELECT doc_id, term, freq FROM tf",
    "bm25_doc_length": f"WITH {index_ctes()} SELECT doc_id, length FROM lengths",
    "bm25_corpus_stats": f"WITH {index_ctes()} SELECT * FROM totals",
    "bm25_doc_freq": f"WITH {index_ctes()} SELECT term, df FROM stats",
    "bm25_idf": f"WITH {index_ctes()} SELECT term, round(idf, 9) AS idf FROM stats",
    "bm25_weights": f"WITH {index_ctes()} SELECT doc_id, term, units / 1e4 AS weight FROM weights",
    "bm25_precision": f"WITH {index_ctes(places=6)} SELECT doc_id, term, units FROM weights",
    "bm25_per_field_prep": with_index(
        "SELECT * FROM ranked WHERE rank <= 10",
        name=words("strip_accents(lower(name))"),
        definition=content_words("definition"),
    ),
    "bm25_search": with_index("SELECT * FROM ranked WHERE rank <= 10"),
    "bm25_search_by_term_join": with_index("SELECT * FROM ranked WHERE rank <= 10"),
    "bm25_hits_join": with_index("SELECT ranked.*, name, lang FROM ranked JOIN docs USING (doc_id) WHERE rank <= 10"),
    "inverted_index": f"""
        WITH {index_ctes()},
        placed AS (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1 AS place FROM tf)
        SELECT term, CAST(place // 128 AS BIGINT) AS block, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)
                 AS doc_ids
        FROM placed GROUP BY term, place // 128""",
    "vocabulary": f"""
        WITH {DOCS},
        arrays AS (SELECT doc_id, {words("name")} AS names, {words("definition")} AS definitions FROM docs),
        tokens AS (
          SELECT doc_id, 0 AS field, unnest(names) AS term, generate_subscripts(names, 1) AS pos FROM arrays
          UNION ALL
          SELECT doc_id, 1, unnest(definitions), generate_subscripts(definitions, 1) FROM arrays),
        first AS (
          SELECT term, doc_id, field, pos FROM tokens
          QUALIFY row_number() OVER (PARTITION BY term ORDER BY doc_id, field, pos) = 1)
        SELECT term, CAST(row_number() OVER (ORDER BY doc_id, field, pos) - 1 AS BIGINT) AS term_id FROM first""",
    "index_stats": f"WITH {index_ctes()} SELECT (SELECT count(*) FROM stats) AS terms, * FROM totals",
    "full_ranking": with_index("SELECT * REPLACE (CAST(rank AS BIGINT) AS rank) FROM ranked"),
    "page_results": with_index("SELECT * FROM ranked WHERE rank > 10 AND rank <= 20"),
    "rerank_topk": f"""
        WITH {CONVERSATIONS}
        SELECT query_id, corpus_id, text, round(score, 9) AS score, rank FROM ranked WHERE rank <= 3""",
    "rerank_with_model": f"WITH {CONVERSATIONS} SELECT query_id, corpus_id, round(score, 9) AS score, CAST(rank AS BIGINT) AS rank FROM ranked",
    "rerank_two_stage": f"""
        WITH {reranked(20, above=0.25)}
        SELECT query_id, id, sim, CAST(first_rank AS BIGINT) AS first_rank, round(rerank_score, 9) AS rerank_score,
               CAST(rank AS BIGINT) AS rank, coalesce(rerank_score < 0.15, sim < 0.78) AS low FROM reordered""",
    "head_sort": f"""
        WITH {reranked(20, above=0.25)}
        SELECT query_id, id, sim, CAST(first_rank AS BIGINT) AS first_rank, round(rerank_score, 9) AS rerank_score,
               CAST(rank AS BIGINT) AS rank, coalesce(rerank_score < 0.15, sim < 0.78) AS low,
               CAST(CASE WHEN rank > 20 THEN rank ELSE row_number() OVER (
                 PARTITION BY query_id, rank > 20 ORDER BY sim DESC, rank) END AS BIGINT) AS new_rank
        FROM reordered""",
    "enrich_metadata": """
        SELECT n_nationkey AS code, c_custkey, 'nation ' || lower(n_name) AS description
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "result_counts": f"""
        WITH {index_ctes()},
        every AS (SELECT item_id AS query_id FROM benchmark UNION ALL SELECT -1)
        SELECT query_id, count(hits.doc_id) AS hits FROM every LEFT JOIN hits USING (query_id) GROUP BY query_id""",
    "list_product": """
        WITH a AS (SELECT p_partkey, unnest([p_brand, p_type]) AS x, unnest([0, 1]) AS i, p_size, p_name FROM part),
        b AS (SELECT *, unnest([CAST(p_size AS VARCHAR), 'any']) AS y, unnest([0, 1]) AS j FROM a),
        c AS (SELECT *, unnest(string_split(p_name, ' ')) AS z,
                     generate_subscripts(string_split(p_name, ' '), 1) - 1 AS k,
                     len(string_split(p_name, ' ')) AS n FROM b)
        SELECT p_partkey, CAST(i * 2 * n + j * n + k AS INTEGER) AS pos, x || '|' || y || '|' || z AS combination FROM c""",
    "sort_variants": f"""
        WITH {SORTED_WORDS}
        SELECT conv_id, turn,
               string_agg(word, ',' ORDER BY word, pos) AS ascending,
               string_agg(word, ',' ORDER BY word DESC, pos) AS descending,
               string_agg(word, ',' ORDER BY length(word), pos) AS by_size,
               string_agg(word, ',' ORDER BY length(word) DESC, pos) AS by_size_down
        FROM placed GROUP BY conv_id, turn
        UNION ALL SELECT conv_id, turn, '', '', '', '' FROM turns WHERE len(words) = 0""",
    "array_pluck": """
        WITH lines AS (SELECT conv_id, turn, [string_split(s, ' ') FOR s IN string_split(text, chr(10))] AS l
                       FROM conversations)
        SELECT conv_id, turn, array_to_string([r[1] FOR r IN l], ',') AS first_words,
               array_to_string([coalesce(r[2], '-') FOR r IN l[1:2]], ',') AS second_words
        FROM lines""",
    "shuffle_rows": "SELECT * FROM customer",
    "shuffle_keyed": """
        WITH copies AS (
          SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment) - 1 AS copy FROM customer),
        hashed AS (
          SELECT *, sha256('7:' || copy || ':{"c_nationkey":' || c_nationkey || ',"c_mktsegment":"' || c_mktsegment || '"}') AS h
          FROM copies)
        SELECT c_nationkey, c_mktsegment, row_number() OVER (ORDER BY h) - 1 AS place FROM hashed""",
    "map_functions": """
        WITH p AS (SELECT event_id, json_keys(props) AS k,
                          [CAST(json_extract(props, x) AS BIGINT) FOR x IN json_keys(props)] AS v FROM events)
        SELECT event_id, array_to_string(k, ',') AS keys, CAST(len(k) AS INTEGER) AS size,
               array_to_string(v, ',') AS values,
               array_to_string(list_transform(k, lambda x, i: x || '=' || v[i] * 2), ',') AS doubled
        FROM p""",
    "value_freq": "SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY c_mktsegment",
    "confusion_matrix": f"WITH {MATRIX} SELECT * FROM matrix",
    "classification_metrics": f"""
        WITH {MATRIX},
        guesses AS (SELECT guess AS label, sum(n) AS guessed, sum(n) FILTER (guess = truth) AS hits FROM matrix GROUP BY guess),
        truths AS (SELECT truth AS label, sum(n) AS occurred FROM matrix GROUP BY truth),
        rated AS (
          SELECT label,
                 {four_places("CAST(hits AS DOUBLE) / nullif(CAST(guessed AS DOUBLE), 0)")} AS precision,
                 {four_places("CAST(hits AS DOUBLE) / nullif(CAST(occurred AS DOUBLE), 0)")} AS recall
          FROM guesses JOIN truths USING (label)),
        metrics AS (
          SELECT label, precision, recall,
                 {four_places("2e0 * precision * recall / nullif(precision + recall, 0)")} AS f_measure
          FROM rated)
        SELECT * FROM metrics
        UNION ALL
        SELECT '(mean)', {four_places("avg(precision)")}, {four_places("avg(recall)")}, {four_places("avg(f_measure)")}
        FROM metrics""",
    "tokenize": f"SELECT doc_id, array_to_string({words('text')}, ' ') AS tokens FROM documents",
    "stopwords": f"SELECT doc_id, array_to_string({content_words('text')}, ' ') AS tokens FROM documents",
    "stem_tokens": f"""
        WITH {MARKED_CONTENT}, {STEMS},
        kept AS (
          SELECT doc_id, list_filter(tokens, lambda t: NOT list_contains({STOP_LIST}, ltrim(t, '!'))) AS tokens
          FROM marked),
        placed AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM kept)
        SELECT doc_id, string_agg(CASE WHEN token LIKE '!%' THEN '!' ELSE '' END || stem, ' ' ORDER BY pos) AS tokens
        FROM placed JOIN stems ON word = ltrim(token, '!') GROUP BY doc_id
        UNION ALL SELECT doc_id, '' FROM kept WHERE len(tokens) = 0""",
    "negation_mark": f"WITH {MARKED} SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM marked",
    "normalize_text": "SELECT doc_id, strip_accents(lower(text)) AS normal FROM documents",
    "highlight": f"""
        WITH {DOCS}
        SELECT doc_id, regexp_replace(definition, '(?i)the a', '<strong>\\0</strong>', 'g') AS marked FROM docs""",
    "stream_ingest": with_index("SELECT * FROM ranked WHERE rank <= 10"),
    "stream_queries": f"WITH {SIMS} SELECT * FROM near WHERE rank <= 5",
    "semantic_search": f"""
        WITH {SIMS} SELECT query_id, id, sim, rank, sim < 0.3 AS low FROM near WHERE sim > 0.25 AND rank <= 10""",
    "keyword_search": with_index(
        "SELECT ranked.*, name, definition FROM ranked JOIN docs USING (doc_id) WHERE rank <= 10"
    ),
    "compare_rankings": compared("SELECT * FROM compared", 0, 0.75),
    "compare_rankings_page_2": compared(
        """SELECT compared.*, a.name AS semantic_name, a.lang AS semantic_lang, b.name AS lexical_name, b.lang AS lexical_lang
        FROM compared LEFT JOIN docs a ON a.doc_id = semantic_id LEFT JOIN docs b ON b.doc_id = lexical_id""",
        10,
        0.2,
    ),
    "rerank_page_2": f"""
        WITH {reranked(20, above=0.25, most=20)}
        SELECT query_id, id, sim, first_rank, round(rerank_score, 9) AS rerank_score, rank,
               coalesce(rerank_score < 0.15, sim < 0.3) AS low FROM reordered WHERE rank > 10 AND rank <= 20""",
    "keyword_page_2": with_index(
        "SELECT ranked.*, name, definition FROM ranked JOIN docs USING (doc_id) WHERE rank > 10 AND rank <= 20"
    ),
    "bm25_weights_split": f"WITH {index_ctes()} SELECT doc_id, term, units / 1e4 AS weight FROM weights",
    "bm25_config": f"WITH {index_ctes()} SELECT doc_id, term, units / 1e4 AS weight FROM weights",
    "vector_topk_nulls": f"""
        WITH {SIMS},
        whole AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS r FROM sims WHERE id % 3 <> 0),
        asked AS (SELECT list_transform(range(64), lambda i: CASE WHEN i % 2 = 0 THEN 0.125e0 ELSE -0.125e0 END) AS q),
        alone AS (SELECT vec_id AS id, round(list_inner_product(v, q), 6) AS sim FROM vectors, asked WHERE vec_id % 3 <> 0)
        SELECT query_id, id, sim FROM whole WHERE r <= 5
        UNION ALL (SELECT -1, id, sim FROM alone ORDER BY sim DESC, id LIMIT 5)""",
    "without_vector": "SELECT count(*) AS without_vector FROM embeddings WHERE vec_id % 3 = 0",
    "search_built_corpus": f"WITH {PARTS} SELECT code AS query_id, 1e0 AS sim FROM defined WHERE definition IS NOT NULL",
    "stream_ingest_rejected": """
        WITH refused AS (
          SELECT doc_id, 'already present' AS reason FROM documents WHERE doc_id % 2 = 0
          UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'already present' ELSE 'repeated in the batch' END
          FROM documents WHERE doc_id % 7 = 1
          UNION ALL SELECT NULL, 'no id' FROM documents WHERE doc_id % 5 = 0)
        SELECT coalesce(CAST(doc_id AS VARCHAR), 'none') AS doc_id, reason, CAST(1 AS BIGINT) AS batch FROM refused""",
    "scan_metadata": r"""
        SELECT CAST(doc_id AS VARCHAR) AS idno, split_part(text, chr(10), 1) AS title, '2024-02-03' AS date_created,
               CAST(least(3, len(regexp_extract_all(lower(text), '\p{L}+'))) AS BIGINT) AS keywords
        FROM documents""",
    "bm25_input_checks": """
        SELECT unnest(['whole', 'repeated', 'without id', 'too few', 'missing field']) AS input,
               unnest([false, true, true, true, true]) AS refused""",
    "bm25_default_prep": default_prep(),
    "build_corpus": f"""
        WITH {PARTS},
        counts AS (
          SELECT *, {letters("lower(name || chr(10) || chr(10) || coalesce(definition, ''))")} AS n FROM defined)
        SELECT code, name, definition,
               CASE WHEN definition IS NOT NULL THEN array_to_string(
                 [CAST(round_even(x / sqrt(list_inner_product(n, n)) * 1e6, 0) AS BIGINT) FOR x IN n], ',') END AS units
        FROM counts""",
}

# Other ways to the same results.
ORACLES["keyword_blockmax"] = ORACLES["keyword_blockmax_by_term_join"] = ORACLES["bm25_search"]
ORACLES["bm25_filtered_bitmap"] = ORACLES["bm25_filtered"]
ORACLES["stream_ingest_sketched"] = ORACLES["stream_ingest_rejected"]
ORACLES["stream_ingest_compacted"] = ORACLES["bm25_search"].replace("AS definitions FROM docs)", "AS definitions FROM docs WHERE doc_id % 7 <> 3)")
ORACLES["vector_topk_pruned"] = ORACLES["standing_queries"] = ORACLES["vector_topk_batch"]
ORACLES["rerank_remembered"] = ORACLES["rerank_with_model"]
# An empty value of a CSV file is null.
ORACLES["scan_split_series"] = ORACLES["scan_series"].replace("definition AS long", "nullif(definition, '') AS long")
ORACLES["highlight_terms"] = with_index(
    r"""SELECT query_id, doc_id, array_to_string(list_transform(p, lambda x: CASE WHEN list_contains(t, strip_accents(lower(x)))
             THEN '<strong>' || x || '</strong>' ELSE x END), '') AS marked,
           CAST(len(list_filter(p, lambda x: list_contains(t, strip_accents(lower(x))))) AS INTEGER) AS n_marked
    FROM (SELECT query_id, doc_id, regexp_extract_all(definition, '\p{L}+|[^\p{L}]+') AS p,
                 list_distinct(list_transform(regexp_extract_all(benchmark.text, '\p{L}+'), lambda x: strip_accents(lower(x)))) AS t
          FROM ranked JOIN docs USING (doc_id) JOIN benchmark ON item_id = query_id WHERE rank <= 10)"""
)
ORACLES["page_after"] = with_index(
    "SELECT query_id, doc_id, score, CAST((rank - 1) % 10 + 1 AS INTEGER) AS rank, CAST((rank - 1) // 10 AS INTEGER) AS page"
    " FROM ranked WHERE rank <= 30"
)
