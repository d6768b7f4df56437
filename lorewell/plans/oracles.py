"""The registered queries written again in plain SQL, for checking the results."""

from __future__ import annotations

# Fixed values, stated here once more so that a wrong entry in the library shows up:
# stop words, relations of the derived edges, excluded relations, mixture, Porter2 endings.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am is are was were be been being have has had having do does did doing
would should could ought a an the and but if or because as until while of at by for with
about against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each few
more most other some such no nor not only own same so than too very
""".split()
RELATIONS = """
RelatedTo Synonym IsA DerivedFrom HasContext Antonym FormOf UsedFor AtLocation CapableOf
PartOf Causes HasA HasProperty MannerOf SimilarTo Desires MadeOf ReceivesAction
""".split()
EXCLUDED_RELATIONS = "/r/Synonym /r/Antonym /r/DerivedFrom".split()
LARGE_MIXTURE = "bst wow convai empathy".split()


def _pairs(text: str) -> dict[str, str]:
    return dict(pair.split(":") for pair in text.split())


SPECIAL = _pairs("""
skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli
only:onli singly:singl sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias
andes:andes inning:inning innings:inning outing:outing outings:outing canning:canning
cannings:canning herring:herring herrings:herring earring:earring earrings:earring
proceed:proceed proceeds:proceed proceeded:proceed proceeding:proceed exceed:exceed
exceeds:exceed exceeded:exceed exceeding:exceed succeed:succeed succeeds:succeed
succeeded:succeed succeeding:succeed
""")
STEP2 = _pairs("""
ization:ize ational:ate fulness:ful ousness:ous iveness:ive tional:tion biliti:ble
lessli:less entli:ent ation:ate alism:al aliti:al ousli:ous iviti:ive fulli:ful enci:ence
anci:ance abli:able izer:ize ator:ate alli:al bli:ble ogi:og li:
""")
STEP3 = _pairs("ational:ate tional:tion alize:al icate:ic iciti:ic ative: ical:ic ness: ful:")
STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()

ORACLES: dict[str, str] = {}


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _cases(pairs, value: str) -> str:
    return "CASE " + value + " ".join(["", *[f"WHEN '{a}' THEN '{b}'" for a, b in pairs]]) + " END"


STOP = _list(STOP_WORDS)
WORD = r"[\p{L}\p{M}\p{N}]+"
MARKED = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s''’-]"
PHRASE = r"trim(regexp_replace(replace(relation, '/r/', ''), '([A-Z]+)', ' \1', 'g'))"

# --- knowledge base --------------------------------------------------------

KB = f"""
fx_tok AS (
  SELECT doc_id, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, lang,
          list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS ws
        FROM documents)),
fx_run AS (
  SELECT lang, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3
  FROM fx_tok WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
fx_pair AS (
  SELECT lang, w, w2, count(*) AS n FROM fx_run
  WHERE w2 IS NOT NULL AND w NOT IN ({STOP}) AND w2 NOT IN ({STOP}) GROUP BY ALL),
fx_phrase AS (
  SELECT lang, w || '_' || w2 AS w, w3 AS w2, count(*) AS n FROM fx_run
  WHERE w3 IS NOT NULL AND w NOT IN ({STOP}) AND w2 NOT IN ({STOP}) AND w3 NOT IN ({STOP})
  GROUP BY ALL HAVING count(*) >= 2),
fx_part AS (
  SELECT lang, w, w2, n, 0 AS shift, CASE WHEN length(w) % 3 = 0 THEN '/n' ELSE '' END AS sfx
  FROM fx_pair
  UNION ALL
  SELECT lang, w, w2, n, 1, '/v' FROM fx_pair WHERE length(w) % 3 = 0 AND length(w2) % 4 = 0
  UNION ALL
  SELECT lang, w, w2, n, 0, '' FROM fx_phrase),
fx_raw AS (
  SELECT '/r/' || list_extract([{_list(RELATIONS)}],
           CAST((7 * length(w) + 3 * length(w2) + shift) % {len(RELATIONS)} AS INTEGER) + 1)
           AS relation,
         '/c/' || lang || '/' || w || sfx AS start_uri,
         '/c/' || lang || '/' || w2 AS end_uri,
         CAST(n AS DOUBLE) / 2.0 AS weight
  FROM fx_part),
fx_assertions AS (
  SELECT '/a/[' || relation || '/,' || start_uri || '/,' || end_uri || '/]' AS uri, * FROM fx_raw),
weighted AS (
  SELECT uri, relation, weight,
         replace(regexp_extract(start_uri, '^/c/en/([^/]*)', 1), '_', ' ') AS start,
         replace(regexp_extract(end_uri, '^/c/en/([^/]*)', 1), '_', ' ') AS "end"
  FROM fx_assertions
  WHERE starts_with(start_uri, '/c/en/') AND starts_with(end_uri, '/c/en/') AND weight >= 1)"""

TOP = """
top_rel AS (
  SELECT relation FROM (SELECT relation, count(*) AS n FROM {edges} GROUP BY relation
                        ORDER BY n DESC, relation LIMIT 16)
  WHERE relation NOT IN ({excluded}))"""


def _top(edges: str) -> str:
    return TOP.format(edges=edges, excluded=_list(EXCLUDED_RELATIONS))


def _suffix(suffixes) -> str:
    return "(" + "|".join(suffixes) + ")$"


V, C = "[aeiouy]", "[^aeiouy]"
SHORT = f"(regexp_matches({{0}}, '^{V}{C}$') OR regexp_matches({{0}}, '{C}{V}[^aeiouywxY]$'))"
STEM = f"""
st_label AS (SELECT start AS label FROM weighted UNION SELECT "end" FROM weighted),
st_y AS (
  SELECT label, regexp_replace(regexp_replace(label, '^y', 'Y'), '({V})y', '\\1Y', 'g') AS w
  FROM st_label),
st_r1 AS (
  SELECT *, CASE WHEN regexp_matches(w, '^(gener|arsen)') THEN 5
                 WHEN starts_with(w, 'commun') THEN 6
                 WHEN regexp_matches(w, '{V}{C}') THEN length(regexp_extract(w, '^.*?{V}{C}'))
                 ELSE length(w) END AS r1 FROM st_y),
st_r2 AS (
  SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '{V}{C}')
                 THEN r1 + length(regexp_extract(substr(w, r1 + 1), '^.*?{V}{C}'))
                 ELSE length(w) END AS r2 FROM st_r1),
st_a AS (
  SELECT label, r1, r2, CASE
    WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2)
    WHEN ends_with(w, 'ied') OR ends_with(w, 'ies')
      THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
    WHEN ends_with(w, 'us') OR ends_with(w, 'ss') THEN w
    WHEN regexp_matches(w, '{V}.+s$') THEN left(w, length(w) - 1)
    ELSE w END AS w FROM st_r2),
st_b0 AS (SELECT *, regexp_extract(w, '(eedly|ingly|edly|eed|ing|ed)$') AS sfx FROM st_a),
st_b1 AS (SELECT *, left(w, length(w) - length(sfx)) AS base FROM st_b0),
st_b AS (
  SELECT label, r1, r2, CASE
    WHEN sfx = '' THEN w
    WHEN sfx IN ('eed', 'eedly') THEN CASE WHEN length(base) >= r1 THEN base || 'ee' ELSE w END
    WHEN NOT regexp_matches(base, '{V}') THEN w
    WHEN regexp_matches(base, '(at|bl|iz)$') THEN base || 'e'
    WHEN regexp_matches(base, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(base, length(base) - 1)
    WHEN r1 >= length(base) AND {SHORT.format("base")} THEN base || 'e'
    ELSE base END AS w FROM st_b1),
st_c AS (
  SELECT label, r1, r2, CASE WHEN regexp_matches(w, '.{C}[yY]$')
    THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM st_b),
st_d0 AS (SELECT *, regexp_extract(w, '{_suffix(STEP2)}') AS sfx FROM st_c),
st_d1 AS (SELECT *, left(w, length(w) - length(sfx)) AS base FROM st_d0),
st_d AS (
  SELECT label, r1, r2, CASE
    WHEN sfx <> '' AND length(base) >= r1 AND (sfx <> 'ogi' OR ends_with(base, 'l'))
      AND (sfx <> 'li' OR regexp_matches(base, '[cdeghkmnrt]$'))
    THEN base || {_cases(STEP2.items(), "sfx")} ELSE w END AS w FROM st_d1),
st_e0 AS (SELECT *, regexp_extract(w, '{_suffix(STEP3)}') AS sfx FROM st_d),
st_e1 AS (SELECT *, left(w, length(w) - length(sfx)) AS base FROM st_e0),
st_e AS (
  SELECT label, r1, r2, CASE
    WHEN sfx <> '' AND length(base) >= CASE WHEN sfx = 'ative' THEN r2 ELSE r1 END
    THEN base || {_cases(STEP3.items(), "sfx")} ELSE w END AS w FROM st_e1),
st_f0 AS (SELECT *, regexp_extract(w, '{_suffix(STEP4)}') AS sfx FROM st_e),
st_f1 AS (SELECT *, left(w, length(w) - length(sfx)) AS base FROM st_f0),
st_f AS (
  SELECT label, r1, r2, CASE
    WHEN sfx <> '' AND length(base) >= r2 AND (sfx <> 'ion' OR regexp_matches(base, '[st]$'))
    THEN base ELSE w END AS w FROM st_f1),
st_g0 AS (SELECT *, left(w, length(w) - 1) AS base FROM st_f),
st_g AS (
  SELECT label, CASE
    WHEN ends_with(w, 'll') AND length(base) >= r2 THEN base
    WHEN ends_with(w, 'e') AND (length(base) >= r2
      OR (length(base) >= r1 AND NOT {SHORT.format("base")})) THEN base
    ELSE w END AS w FROM st_g0),
stems AS (
  SELECT label, CASE
    WHEN length(label) <= 2 THEN label
    WHEN label IN ({_list(SPECIAL)}) THEN {_cases(SPECIAL.items(), "label")}
    ELSE replace(w, 'Y', 'y') END AS stem FROM st_g),
filtered AS (
  SELECT w.* FROM weighted w JOIN stems a ON a.label = w.start JOIN stems b ON b.label = w."end"
  WHERE a.stem <> b.stem)"""


def _collapsed(edges: str) -> str:
    return f"""SELECT start, "end", arg_max(relation, uri) AS relation, arg_max(weight, uri) AS weight
  FROM {edges} GROUP BY start, "end\""""


# labels, stems and top relations as in the full job
EDGES = (
    KB
    + ","
    + STEM
    + ","
    + _top("filtered")
    + f""",
restricted AS (SELECT * FROM filtered WHERE relation IN (SELECT relation FROM top_rel)),
edges AS ({_collapsed("restricted")})"""
)

ORACLES["kb_english_edges"] = (
    f'WITH {KB} SELECT uri, relation, start, "end", weight FROM weighted'
)
ORACLES["kb_relation_share"] = f"""WITH {KB}
SELECT relation, count(*) AS n,
  CAST(round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS VARCHAR) || '%' AS share
FROM weighted GROUP BY relation"""
ORACLES["kb_top_relations"] = f"""WITH {KB}, {_top("weighted")}
SELECT relation, '__' || replace(relation, '/r/', '') || '__' AS token FROM top_rel"""
ORACLES["kb_restricted_edges"] = f"""WITH {KB}, {_top("weighted")}
SELECT uri, '__' || replace(relation, '/r/', '') || '__' AS token, {PHRASE} AS phrase, weight
FROM weighted WHERE relation IN (SELECT relation FROM top_rel)"""
ORACLES["kb_collapsed_edges"] = f"WITH {KB} {_collapsed('weighted')}"
ORACLES["kb_triple_text"] = f"""WITH {KB}
SELECT DISTINCT start || '__' || replace(relation, '/r/', '') || '__' || "end" AS triple_key,
  start || ' ' || {PHRASE} || ' ' || "end" AS triple_text FROM weighted"""
ORACLES["kb_stem_labels"] = f"WITH {KB}, {STEM} SELECT label, stem FROM stems"
ORACLES["kb_drop_same_stem"] = (
    f'WITH {KB}, {STEM} SELECT uri, start, "end", weight FROM filtered'
)
ORACLES["kb_drop_inverse_pairs"] = f"""WITH {KB}, e AS ({_collapsed("weighted")})
SELECT start, relation, "end", weight FROM e
WHERE start <= "end" OR NOT EXISTS (
  SELECT 1 FROM e o WHERE o.start = e."end" AND o."end" = e.start AND o.relation = e.relation)"""

# --- text ------------------------------------------------------------------


def _text(source: str) -> str:
    """Sentences, words and first mentions of `source(conv_id, turn, text)`."""
    return f"""
sent AS (
  SELECT conv_id, turn, unnest(ss) AS sentence,
         CAST(generate_subscripts(ss, 1) - 1 AS BIGINT) AS sent_no
  FROM (SELECT conv_id, turn, list_filter(list_transform(
          regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda s: trim(s, E' \\t\\r')),
          lambda s: s <> '') AS ss FROM {source})),
tok AS (
  SELECT conv_id, turn, sent_no, unnest(ts) AS w, generate_subscripts(ts, 1) AS i
  FROM (SELECT conv_id, turn, sent_no, regexp_extract_all(lower(sentence), '{MARKED}') AS ts
        FROM sent)),
flag AS (
  SELECT *, CASE WHEN w IN ({STOP}) OR NOT regexp_matches(w, '^{WORD}') THEN 1 ELSE 0 END AS cut
  FROM tok),
run AS (
  SELECT *, sum(cut) OVER (PARTITION BY conv_id, turn, sent_no ORDER BY i) AS run FROM flag),
word AS (SELECT conv_id, turn, sent_no, run, i, w FROM run WHERE cut = 0),
tf AS (SELECT conv_id, turn, sent_no, w, count(*) AS c FROM word GROUP BY ALL),
snorm AS (SELECT conv_id, turn, sent_no, sum(c * c) AS n FROM tf GROUP BY ALL)"""


LEMMA = "CASE WHEN length(w) > 4 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END"


GROUP_NO = "dense_rank() OVER (PARTITION BY conv_id, turn, sent_no ORDER BY run) - 1 AS group_no"
FRESH = """SELECT * FROM {0} QUALIFY
  row_number() OVER (PARTITION BY {1}, w ORDER BY turn, sent_no, i) = 1"""


def _terms(scope: str, renumber: bool = True) -> str:
    """Groups are numbered after repeats are dropped, or before."""
    if renumber:
        fresh = f"SELECT *, {GROUP_NO} FROM ({FRESH.format('word', scope)})"
    else:
        fresh = FRESH.format(f"(SELECT *, {GROUP_NO} FROM word)", scope)
    return f"""
fresh AS (SELECT *, {LEMMA} AS lemma FROM ({fresh})),
terms AS (
  SELECT conv_id, turn, sent_no, group_no, lemma AS term FROM fresh
  UNION ALL
  SELECT conv_id, turn, sent_no, group_no, string_agg(lemma, ' ' ORDER BY i) FROM fresh
  GROUP BY conv_id, turn, sent_no, group_no HAVING count(*) > 1)"""


TEXT = _text("conversations")
TERMS = TEXT + "," + _terms("conv_id, turn")

ORACLES["text_sentences"] = f"WITH {TEXT} SELECT conv_id, turn, sent_no, sentence FROM sent"
ORACLES["text_tokens"] = f"""WITH {TEXT}, numbered AS (
  SELECT conv_id, turn, sent_no, w AS surface,
    dense_rank() OVER (PARTITION BY conv_id, turn, sent_no ORDER BY run) - 1 AS group_no,
    row_number() OVER (PARTITION BY conv_id, turn, sent_no, run ORDER BY i) - 1 AS pos
  FROM word)
SELECT * FROM numbered QUALIFY
  row_number() OVER (PARTITION BY conv_id, turn, surface ORDER BY sent_no, group_no, pos) = 1"""
ORACLES["text_lemmas"] = f"""WITH {TEXT}
SELECT conv_id, turn, {LEMMA} AS term, count(*) AS n FROM word GROUP BY ALL"""
ORACLES["text_groups"] = (
    f"WITH {TERMS} SELECT conv_id, turn, sent_no, group_no, term FROM terms"
)

# --- knowledge -------------------------------------------------------------

SCORES = f"""
tw AS (
  SELECT start, relation, "end", unnest(list_filter(regexp_extract_all(
    lower(start || ' ' || {PHRASE} || ' ' || "end"), '{WORD}'),
    lambda x: x NOT IN ({STOP}))) AS w FROM edges),
tt AS (SELECT start, relation, "end", w, count(*) AS c FROM tw GROUP BY ALL),
tnorm AS (SELECT start, relation, "end", sum(c * c) AS n FROM tt GROUP BY ALL),
cand AS (
  SELECT t.conv_id, t.turn, t.sent_no, t.group_no, e.start, e.relation, e."end"
  FROM terms t JOIN edges e ON e.start = t.term),
dots AS (
  SELECT d.conv_id, d.turn, d.sent_no, d.start, d.relation, d."end", sum(tf.c * tt.c) AS dot
  FROM (SELECT DISTINCT conv_id, turn, sent_no, start, relation, "end" FROM cand) d
  JOIN tt USING (start, relation, "end")
  JOIN tf ON tf.conv_id = d.conv_id AND tf.turn = d.turn AND tf.sent_no = d.sent_no AND tf.w = tt.w
  GROUP BY ALL),
scored AS (
  SELECT c.*, CASE WHEN s.n * t.n > 0
    THEN CAST(coalesce(d.dot, 0) AS DOUBLE) / sqrt(CAST(s.n * t.n AS DOUBLE)) ELSE 0.0 END AS score
  FROM cand c
  LEFT JOIN dots d USING (conv_id, turn, sent_no, start, relation, "end")
  LEFT JOIN snorm s USING (conv_id, turn, sent_no)
  LEFT JOIN tnorm t USING (start, relation, "end")),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn, sent_no, group_no
    ORDER BY score DESC, start, relation, "end") AS rank FROM scored QUALIFY rank <= 3)"""


def _distinct(scope: str) -> str:
    return f"""
SELECT conv_id, turn, sent_no, group_no, rank, start, relation, "end", round(score, 6) AS score
FROM ranked QUALIFY row_number() OVER (PARTITION BY {scope}, start, relation, "end"
  ORDER BY turn, sent_no, group_no, rank) = 1"""


def _knowledge(source: str) -> str:
    """`known(conv_id, turn, start, relation, end, place)`, one row per triple of a message."""
    return (
        EDGES
        + ","
        + _text(source)
        + ","
        + _terms("conv_id, turn")
        + ","
        + SCORES
        + """,
known AS (
  SELECT conv_id, turn, start, relation, "end", row_number() OVER (
    PARTITION BY conv_id, turn ORDER BY sent_no, group_no, rank) AS place
  FROM (SELECT * FROM ranked QUALIFY row_number() OVER (
    PARTITION BY conv_id, turn, start, relation, "end" ORDER BY sent_no, group_no, rank) = 1))"""
    )


ORACLES["candidate_triples"] = f"""WITH {EDGES}, {TERMS}
SELECT t.conv_id, t.turn, t.sent_no, t.group_no, t.term, e.relation, e."end", e.weight
FROM terms t JOIN edges e ON e.start = t.term"""
ORACLES["score_sparse"] = f"""WITH {EDGES}, {TERMS}, {SCORES}
SELECT conv_id, turn, sent_no, group_no, start, relation, "end", round(score, 6) AS score
FROM scored"""
ORACLES["score_dense_topk"] = """WITH near AS (
  SELECT vec_id, embedding AS vec, unnest(range(vec_id + 1, vec_id + 9)) AS other_id
  FROM embeddings),
scored AS (
  SELECT n.vec_id, n.other_id,
    list_cosine_similarity(CAST(n.vec AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score
  FROM near n JOIN embeddings e ON e.vec_id = n.other_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other_id) AS rank
  FROM scored)
SELECT vec_id, rank, other_id, round(score, 6) AS score FROM ranked WHERE rank <= 3"""
ORACLES["extract_knowledge"] = f"WITH {EDGES}, {TERMS}, {SCORES} {_distinct('conv_id, turn')}"

DENSE = f"""
wv AS (
  SELECT w, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
  FROM (SELECT w, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings) AS vec_id
        FROM (SELECT w FROM tf UNION SELECT w FROM tw))
  JOIN embeddings USING (vec_id)),
sdim AS (
  SELECT conv_id, turn, sent_no, d, sum(c * v[d]) AS x
  FROM tf JOIN wv USING (w), generate_series(1, 64) g(d) GROUP BY ALL),
svec AS (SELECT conv_id, turn, sent_no, list(x ORDER BY d) AS v FROM sdim GROUP BY ALL),
tdim AS (
  SELECT start, relation, "end", d, sum(c * v[d]) AS x
  FROM tt JOIN wv USING (w), generate_series(1, 64) g(d) GROUP BY ALL),
tvec AS (SELECT start, relation, "end", list(x ORDER BY d) AS v FROM tdim GROUP BY ALL),
pair AS (
  SELECT c.*, list_dot_product(s.v, t.v) AS dot,
    sqrt(list_dot_product(s.v, s.v)) * sqrt(list_dot_product(t.v, t.v)) AS norm
  FROM cand c LEFT JOIN svec s USING (conv_id, turn, sent_no) LEFT JOIN tvec t USING (start, relation, "end")),
dense AS (SELECT *, CASE WHEN norm > 0 THEN dot / norm ELSE 0.0::DOUBLE END AS score FROM pair),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn, sent_no, group_no
    ORDER BY score DESC, start, relation, "end") AS rank FROM dense QUALIFY rank <= 3)"""
CANDIDATES = SCORES[: SCORES.index("dots AS")].rstrip().rstrip(",")
ORACLES["extract_dense"] = f"WITH {EDGES}, {TERMS}, {CANDIDATES}, {DENSE} {_distinct('conv_id, turn')}"
ORACLES["extract_annotated"] = ORACLES["extract_knowledge"]
COMPOUND = f"""
near AS (
  SELECT conv_id, turn, sent_no, i,
    lead(cut) OVER (PARTITION BY conv_id, turn, sent_no ORDER BY i) AS next_cut FROM flag),
said AS (SELECT word.*, next_cut FROM word JOIN near USING (conv_id, turn, sent_no, i)),
fresh AS (
  SELECT *, {GROUP_NO}, CASE WHEN next_cut = 0 THEN w ELSE {LEMMA} END AS lemma
  FROM ({FRESH.format("said", "conv_id, turn")}))"""
ORACLES["annotated_terms"] = f"""WITH {TEXT}, {COMPOUND}
SELECT conv_id, turn, sent_no, group_no, lemma AS term FROM fresh
UNION ALL
SELECT conv_id, turn, sent_no, group_no, string_agg(lemma, ' ' ORDER BY i) FROM fresh
GROUP BY conv_id, turn, sent_no, group_no HAVING count(*) > 1"""
ORACLES["extract_context"] = (
    f"WITH {EDGES}, {TEXT}, {_terms('conv_id', False)}, {SCORES} {_distinct('conv_id')}"
)
ORACLES["stream_context"] = ORACLES["extract_context"]

# --- augmentation ----------------------------------------------------------

KEY = "start || '__' || replace(relation, '/r/', '') || '__' || \"end\""
SENTENCE = f"start || ' ' || {PHRASE} || ' ' || \"end\""

CELLS = f"""
cells AS (
  SELECT conv_id, turn,
    string_agg('__knowledge__' || {KEY} || '__endknowledge__', '' ORDER BY place) AS enveloped,
    string_agg({SENTENCE}, '. ' ORDER BY place) AS dotted,
    string_agg({SENTENCE}, '|' ORDER BY place) AS listed,
    count(*) AS n
  FROM known GROUP BY conv_id, turn)"""

ORACLES["augment_turns"] = f"""WITH {_knowledge("conversations")}, {CELLS}
SELECT c.conv_id, c.turn, c.text || chr(10) || '__knowledge__' || coalesce(k.dotted, '')
  || '__endknowledge__' AS text
FROM conversations c LEFT JOIN cells k USING (conv_id, turn)"""
ORACLES["stream_augment"] = ORACLES["augment_turns"]
ORACLES["knowledge_cells"] = f"""WITH {_knowledge("conversations")}, {CELLS}
SELECT c.conv_id, c.turn, coalesce(k.listed, '') AS listed, coalesce(k.n, 0) AS n_listed,
  coalesce(k.n, 0) AS n_enveloped
FROM conversations c LEFT JOIN cells k USING (conv_id, turn)"""

PLACED = """
flat AS (SELECT conv_id, turn, role, replace(text, chr(10), ' ') AS text FROM conversations),
placed AS (
  SELECT *, 'f' || CAST(conv_id // 64 AS VARCHAR) AS file,
    row_number() OVER (PARTITION BY conv_id // 64 ORDER BY conv_id, turn) AS seq,
    lag(text) OVER c AS prev, lead(text) OVER c AS next,
    max(turn) OVER (PARTITION BY conv_id) AS last_turn
  FROM flat WINDOW c AS (PARTITION BY conv_id ORDER BY turn))"""
ESCAPED = "replace(replace({0}, ',', '_comma_'), '|', '_pipe_')"
TWO = f"regexp_extract_all(lower(text), '{WORD}')[1:2]"

CONVAI = """
lines AS (
  SELECT *, seq AS line_no, role = 'system' AS persona,
    CAST(turn + 1 AS VARCHAR) || CASE WHEN role = 'system' THEN ' your persona: ' || text
      ELSE ' ' || text END AS head,
    chr(9) || next || chr(9) || chr(9) || next || '|' || role AS tail
  FROM placed WHERE next IS NOT NULL),
queries AS (
  SELECT conv_id, turn, regexp_replace(head, '^[0-9 ]+', '') AS text FROM lines WHERE NOT persona)"""
ORACLES["augment_convai"] = f"""WITH {PLACED}, {CONVAI}, {_knowledge("queries")}, {CELLS}
SELECT l.file, l.line_no, CASE WHEN persona THEN l.head
  ELSE l.head || coalesce(k.enveloped, '') || l.tail END AS line
FROM lines l LEFT JOIN cells k USING (conv_id, turn)"""

BST = f"""
lines AS (
  SELECT *, seq AS line_no,
    'text:' || coalesce(prev, '') || chr(9) || 'free_message:' || text || chr(9) || 'labels:' || next
      || CASE WHEN turn + 1 = last_turn THEN chr(9) || 'episode_done:True' ELSE '' END AS line,
    {TWO} AS two
  FROM placed WHERE next IS NOT NULL)"""
ORACLES["augment_bst"] = (
    f"WITH {PLACED}, {BST}, {_knowledge('lines')}, {CELLS}"
    r"""
SELECT l.file, l.line_no, regexp_replace(l.line, '^\s+|\s+$', '', 'g') || chr(9) || 'concepts:'
  || coalesce(k.enveloped, '') AS line
FROM lines l LEFT JOIN cells k USING (conv_id, turn)"""
)

ED = f"""
lines AS (
  SELECT *, seq + 1 AS line_no, 'hit:' || conv_id || ',' || (turn + 1) || ',' || role || ','
    || {ESCAPED.format("left(text, 20)")} || ',0,' || {ESCAPED.format("text")} || ',x,'
    || CASE WHEN conv_id % 7 = 0 AND turn = 1 THEN '<POLITICAL>' ELSE '' END
    || CASE WHEN conv_id % 2 = 0 THEN ',' || {ESCAPED.format("text")} || '|' || role ELSE '' END
    AS line
  FROM placed),
queries AS (
  SELECT conv_id, turn, replace({ESCAPED.format("text")}, '_comma_', ',') AS text FROM lines)"""
ORACLES["augment_ed"] = (
    f"WITH {PLACED}, {ED}, {_knowledge('queries')}, {CELLS}"
    r"""
SELECT l.file, l.line_no, regexp_replace(l.line, '^\s+|\s+$', '', 'g') || ','
  || coalesce(k.enveloped, '') AS line
FROM lines l LEFT JOIN cells k USING (conv_id, turn)
UNION ALL
SELECT DISTINCT file, 1,
  'conv_id,utterance_idx,context,prompt,speaker_idx,utterance,selfeval,tags,concepts' FROM placed"""
)

ORACLES["augment_wow"] = f"""WITH {_knowledge("conversations")}, {CELLS}
SELECT conv_id, CAST(0 AS BIGINT) AS part, arg_min({TWO}[1], turn) AS chosen_topic,
  string_agg(CASE WHEN role = 'assistant' THEN '1_Wizard' ELSE '0_Apprentice' END || ':' || text
    || coalesce(k.enveloped, ''), chr(10) ORDER BY turn) AS dialog
FROM conversations LEFT JOIN cells k USING (conv_id, turn) GROUP BY conv_id"""

ORACLES["backport"] = f"""WITH {PLACED}, {BST}, by_text AS (
  SELECT text, arg_max(two, conv_id * 1000000 + turn) AS two
  FROM (SELECT *, {TWO} AS two FROM flat) GROUP BY text)
SELECT l.file, l.line_no, CAST(0 AS BIGINT) AS field_no,
  trim(l.line) || chr(9) || 'concepts:' || array_to_string(b.two, '|') AS line, true AS found
FROM lines l JOIN by_text b ON b.text = l.text"""

# --- examples --------------------------------------------------------------

ENVELOPED = "chr(10) || '__knowledge__' || {0} || '__endknowledge__'"
NO_LABELS = "(turn + 1 = last_turn AND conv_id % 7 = 3)"
ORACLES["bst_examples"] = f"""WITH {PLACED}, {BST}, e AS (
  SELECT *, turn + 1 = last_turn AS done FROM lines),
n AS (
  SELECT *, NOT {NO_LABELS} AS valid, max(line_no) OVER (PARTITION BY file) AS n_lines,
    CAST(coalesce(sum(CASE WHEN done THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS episode_id FROM e)
SELECT file, line_no, episode_id,
  coalesce(prev, '') || {ENVELOPED.format("array_to_string(two, '. ')")} AS text,
  next AS labels, n_lines,
  line_no = max(line_no) OVER (PARTITION BY file, episode_id) AS episode_done
FROM n WHERE valid"""
ORACLES["episode_stats"] = f"""WITH {PLACED}, {BST}, n AS (
  SELECT *, max(line_no) OVER (PARTITION BY file) AS all_lines FROM lines)
SELECT file, count(*) AS n_examples, count(DISTINCT conv_id) AS n_episodes, max(all_lines) AS n_lines,
  count(DISTINCT conv_id) = 1 AND max(all_lines) > 100 AS one_long_episode
FROM n WHERE NOT {NO_LABELS} GROUP BY file"""
ORACLES["validate_examples"] = f"""WITH {PLACED}, {BST}
SELECT file, line_no, CASE WHEN {NO_LABELS} THEN 'missing labels in line ' || line_no || '; ' ELSE '' END
  || 'missing concepts in line ' || line_no AS errors FROM lines"""
ORACLES["quarantine"] = f"""WITH {PLACED}, {BST}, rule AS (
  SELECT file, line_no, CASE WHEN turn + 1 <> last_turn THEN NULL ELSE CASE conv_id % 7
    WHEN 5 THEN 'eval_labels' WHEN 4 THEN 'missing text' WHEN 3 THEN 'missing labels'
    WHEN 6 THEN 'missing concepts' END END AS rule
  FROM lines),
n AS (
  SELECT count(*) AS n_lines, count(rule) AS n_bad, count(*) FILTER (rule = 'eval_labels') AS n_eval_labels,
    count(*) FILTER (rule = 'missing text') AS n_missing_text,
    count(*) FILTER (rule = 'missing labels') AS n_missing_labels,
    count(*) FILTER (rule = 'missing concepts') AS n_missing_concepts
  FROM rule)
SELECT file, line_no, rule || ' in line ' || line_no AS errors, n.* FROM rule, n WHERE rule IS NOT NULL"""
ORACLES["ed_examples"] = f"""WITH {PLACED}, l AS (
  SELECT *, seq + 1 AS line_no, {TWO} AS two FROM placed),
p AS (
  SELECT *, lag(two) OVER c AS prev_two, min(line_no) OVER (PARTITION BY conv_id) AS run_start
  FROM l WINDOW c AS (PARTITION BY conv_id ORDER BY turn))
SELECT file, run_start, line_no, turn + 1 AS turn,
  replace(replace(prev, '|', '_pipe_'), '_comma_', ',')
    || {ENVELOPED.format("array_to_string(prev_two, '. ')")} AS text,
  replace(replace(text, '|', '_pipe_'), '_comma_', ',') AS label,
  role AS prompt,
  replace(replace(left(text, 20), '|', '_pipe_'), '_comma_', ',') AS situation,
  CASE WHEN conv_id % 2 = 0 THEN replace(replace(text, '_comma_', ','), '_pipe_', '|') || '|' || role
    ELSE '' END AS candidates,
  conv_id % 7 = 0 AND turn IN (1, 2) AS is_political,
  CASE WHEN turn % 2 = 1 THEN 'experiencer' ELSE 'responder' END AS context_role
FROM p WHERE prev IS NOT NULL"""
ORACLES["wow_examples"] = f"""WITH e AS (
  SELECT *, CAST(0 AS BIGINT) AS part, turn AS pos, {TWO} AS two FROM conversations),
d AS (
  SELECT *, first_value(role) OVER w = 'assistant' AS opens, first_value(two[1]) OVER w AS topic,
    lead(text) OVER w AS answer, max(pos) OVER (PARTITION BY conv_id, part) AS last_pos
  FROM e WINDOW w AS (PARTITION BY conv_id, part ORDER BY turn)),
n AS (SELECT *, pos - CASE WHEN opens THEN 1 ELSE 0 END AS p FROM d)
SELECT conv_id, part, p // 2 AS entry_no,
  CASE WHEN p = 0 THEN coalesce(topic, '') || chr(10) ELSE '' END || text
    || {ENVELOPED.format("array_to_string(two, '. ')")} AS text,
  answer AS labels, pos + 3 > last_pos AS episode_done, coalesce(topic, '') AS chosen_topic
FROM n WHERE p >= 0 AND p % 2 = 0 AND answer IS NOT NULL"""
ORACLES["convai_examples"] = f"""WITH {PLACED}, {CONVAI}
SELECT file, line_no, turn + 1 AS number,
  CAST(sum(CASE WHEN turn = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no) - 1
    AS BIGINT) AS episode_id,
  CASE WHEN persona THEN 'your persona: ' ELSE '' END || text AS text,
  CASE WHEN persona THEN '' ELSE next END AS labels,
  CASE WHEN persona THEN '' ELSE next || '|' || role END AS label_candidates,
  persona AS is_persona
FROM lines"""
CODE = """CAST(list_sum(list_transform({0}.embedding,
  lambda x, i: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) * i)) AS BIGINT)"""
ORACLES["row_vectors"] = f"""WITH {PLACED}
SELECT p.file, p.seq + 1 AS line_no, {CODE.format("a")} AS context_code, {CODE.format("b")} AS label_code
FROM placed p LEFT JOIN embeddings a ON a.vec_id = p.seq - 2
LEFT JOIN embeddings b ON b.vec_id = p.seq - 1 WHERE p.prev IS NOT NULL"""
ORACLES["label_prefix"] = """WITH s AS (
  SELECT vec_id, unnest(range(0, 64)) AS d, unnest(embedding) AS v FROM embeddings),
r AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, d) AS rank FROM s
  QUALIFY rank <= 3),
p AS (SELECT vec_id, string_agg('l' || lpad(CAST(d AS VARCHAR), 2, '0') || ' ', '' ORDER BY rank DESC) AS prefix FROM r GROUP BY 1)
SELECT conv_id, turn, coalesce(prefix, '') || text AS text
FROM conversations LEFT JOIN p ON p.vec_id = conv_id"""
ORACLES["sample_contexts"] = """WITH o AS (SELECT conv_id, text FROM conversations WHERE turn = 0),
c AS (SELECT *, row_number() OVER (ORDER BY md5('7:' || conv_id)) AS no FROM o),
e AS (
  SELECT conv_id, CAST('0x' || substr(md5('7:' || conv_id), 1, 15) AS BIGINT)
    % (SELECT count(*) FROM o) + 1 AS no FROM o)
SELECT e.conv_id AS episode_id, c.conv_id AS context_id, c.text AS context FROM e JOIN c USING (no)"""
ORACLES["mix_datasets"] = f"""WITH r AS (
  SELECT [{_list(LARGE_MIXTURE)}][CAST(conv_id % 4 AS INTEGER) + 1] AS dataset,
    conv_id || ':' || turn AS id FROM conversations),
p AS (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('7:' || id)) AS place,
    count(*) OVER (PARTITION BY dataset) AS size, count(*) OVER () AS total FROM r),
q AS (
  SELECT *, total * CASE WHEN dataset = 'bst' THEN 1 ELSE 3 END // 10 AS quota FROM p),
k AS (SELECT *, quota // size + CASE WHEN place <= quota % size THEN 1 ELSE 0 END AS n FROM q)
SELECT dataset, id, unnest(range(n)) AS copy FROM k"""
ORACLES["interleave_datasets"] = ORACLES["mix_datasets"].replace(
    "SELECT dataset, id, unnest(range(n)) AS copy FROM k",
    """, c AS (SELECT dataset, id, place, size, quota, unnest(range(n)) AS copy FROM k)
SELECT row_number() OVER (
    ORDER BY CAST(2 * (copy * size + place - 1) + 1 AS DOUBLE) / CAST(quota AS DOUBLE), dataset) - 1 AS position,
  dataset, id, copy FROM c""",
)
ORACLES["truncate_history"] = """WITH h AS (
  SELECT conv_id, turn, text, string_split(string_agg(text, '  ') OVER (PARTITION BY conv_id
    ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) || '  __end__', ' ') AS ws
  FROM conversations)
SELECT conv_id, turn, array_to_string(ws[-32:], ' ') AS history,
  array_to_string(string_split(text, ' ')[1:12], ' ') AS label FROM h"""

# --- sources and sinks -----------------------------------------------------

ORACLES["io_assertions"] = f"""WITH {KB}
SELECT lang AS file, row_number() OVER (PARTITION BY lang ORDER BY uri) AS line_no, uri, relation, start_uri,
  end_uri, weight
FROM (SELECT *, regexp_extract(start_uri, '^/c/([a-z]+)/', 1) AS lang FROM fx_assertions)"""
ORACLES["io_edges"] = f"""WITH {KB}
SELECT uri, relation, start_uri, end_uri, weight AS raw_weight, weight FROM fx_assertions
WHERE starts_with(start_uri, '/c/en/') AND starts_with(end_uri, '/c/en/') AND weight >= 1"""
ORACLES["io_lines"] = f"""WITH {PLACED}, {ED}
SELECT file, line_no, line FROM lines
UNION ALL
SELECT DISTINCT file, 1, 'conv_id,utterance_idx,context,prompt,speaker_idx,utterance,selfeval,tags' FROM placed"""
ORACLES["io_layout"] = f"""WITH {PLACED}, {BST}, laid AS (
  SELECT CASE WHEN CAST(substr(file, 2) AS BIGINT) % 2 = 0 THEN 'train' ELSE 'valid' END AS split, * FROM lines)
SELECT split, row_number() OVER (PARTITION BY split ORDER BY file, line_no) AS line_no,
  CASE WHEN split = 'train' THEN 'again ' ELSE '' END || line AS line FROM laid"""
ORACLES["io_episodes"] = f"""
SELECT conv_id, arg_min({TWO}[1], turn) AS chosen_topic, count(*) AS n,
  string_agg(CASE WHEN role = 'assistant' THEN '1_Wizard' ELSE '0_Apprentice' END || ':' || text, chr(10)
    ORDER BY turn) AS dialog
FROM conversations GROUP BY conv_id"""
