"""DuckDB SQL twins of the catalogue queries (the correctness oracle).

Views ``documents events embeddings pages conversations benchmark ...`` are
registered by the checker. Patterns and thresholds are written here again,
not taken from the code under test; RE2 needs ``\\1`` for group references and has no
look-around, so the upper-case word count is written as "word runs that are
all capitals", which is the same set of matches.
"""

from __future__ import annotations

from eventlens.functions.text import ENGLISH_STOP_WORDS
from eventlens.plans import catalog as cat
from eventlens.sources.files import PANDAS_NA_TOKENS

# The rules once more, written for RE2 and apart from the code under test: only fixed word lists are shared with it.
SPACE = r"\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NO_SPACE = f"[^{SPACE}]+"
LETTERS = r"\p{L}\p{N}_"
LINK, WWW, MENTION_ANY = f"http{NO_SPACE}", f"www{NO_SPACE}", f"@{NO_SPACE}"
KEPT_EMOJI = r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
COUNTED_EMOJI = (
    r"[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}]+"
)
TITLE_TERMS, MIN_EVENT_ROWS, COHERENCE_MAX_TERMS, COHERENCE_EPS = 3, 10, 3000, 1e-9
MIN_GROUP_FLOOR, MIN_GROUP_FRACTION, NEIGHBOURS, THRESHOLD_QUANTILE = 10, 0.001, 4, 0.9

STOP_SQL = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS) + ")"


def _rr(x: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{repl}', 'g')"


def clean_semantic(x: str) -> str:
    t = f"lower({x})"
    for p in (LINK, WWW, MENTION_ANY):
        t = _rr(t, p)
    t = f"replace({t}, '#', '')"
    found = _rr(t, "[^a-z]+", " ")
    return f"trim({found})"


def clean_emotion(x: str) -> str:
    t = f"lower({x})"
    for p in (LINK, WWW, MENTION_ANY):
        t = _rr(t, p)
    t = f"replace({t}, '#', '')"
    t = _rr(t, f"[^a-zA-Z0-9{SPACE}{KEPT_EMOJI}]+", " ")
    found = _rr(t, f"[{SPACE}]+", " ")
    return f"trim({found})"


STEPS = {
    "strip_urls": lambda x: _rr(x, f"https?://{NO_SPACE}|www\\.{NO_SPACE}"),
    "strip_mentions": lambda x: _rr(x, f"@[{LETTERS}]+"),
    "strip_rt": lambda x: _rr(x, f"^RT[{SPACE}]+"),
    "strip_lead_punct": lambda x: _rr(x, f"^[:\\-{SPACE}]+"),
    "unhash": lambda x: _rr(x, f"#([{LETTERS}]+)", "\\1"),
    "cap_bang": lambda x: _rr(x, "!{4,}", "!!!"),
    "cap_question": lambda x: _rr(x, "\\?{4,}", "???"),
    "cap_mixed": lambda x: _rr(x, "!{3,}\\?{3,}", "!!!???"),
    "squash_ws": lambda x: "trim(" + _rr(_rr(x, "[\\r\\n\\t]", " "), f"[{SPACE}]+", " ") + ")",
}


def clean_display(x: str) -> str:
    # The repair step is the identity on every oracle input: each one holds a
    # character above U+00FF (the decoration's emoji), which disqualifies repair.
    t = x
    for step in STEPS.values():
        t = step(t)
    return f"coalesce({t}, '')"


def mojibake(x: str) -> str:
    """UTF-8 bytes of every character, each read back as the Latin-1 character of that byte."""
    cp = "unicode(c)"
    b = lambda v: f"chr({v})"
    return (
        f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE "
        f"WHEN {cp} < 128 THEN c "
        f"WHEN {cp} < 2048 THEN {b(f'192 + {cp} // 64')} || {b(f'128 + {cp} % 64')} "
        f"WHEN {cp} < 65536 THEN {b(f'224 + {cp} // 4096')} || {b(f'128 + ({cp} // 64) % 64')} || {b(f'128 + {cp} % 64')} "
        f"ELSE {b(f'240 + {cp} // 262144')} || {b(f'128 + ({cp} // 4096) % 64')} || {b(f'128 + ({cp} // 64) % 64')} "
        f"|| {b(f'128 + {cp} % 64')} END), '')"
    )


def count_char(x: str, ch: str) -> str:
    return f"(length({x}) - length(replace({x}, '{ch}', '')))"


def upper_words(x: str) -> str:
    return (
        f"coalesce(len(list_filter(regexp_extract_all({x}, '[{LETTERS}]+'), "
        f"lambda w: regexp_full_match(w, '[A-Z]{{2,}}'))), 0)"
    )


def title_case(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


DECORATED = (
    f"SELECT doc_id, '{cat.DECORATION_PREFIX}' || CAST(doc_id AS VARCHAR) || '{cat.DECORATION_MIDDLE}' || text "
    f"|| '{cat.DECORATION_SUFFIX}' AS raw_text FROM documents"
)

CLEAN_POSTS = f"""
posts_all AS (
  SELECT doc_id, source, lang, text AS raw_text, {clean_semantic('text')} AS clean_text
  FROM documents WHERE text IS NOT NULL
),
posts AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY clean_text ORDER BY doc_id) AS rn
    FROM posts_all WHERE length(clean_text) > 10
  ) WHERE rn = 1
)"""


def titles_sql(posts: str, key: str) -> str:
    """Title rule over a CTE named ``posts`` with columns (key, clean_text)."""
    return f"""
sizes AS (SELECT {key}, count(*) AS num_tweets FROM {posts} GROUP BY {key}),
toks AS (SELECT {key}, unnest(string_split(clean_text, ' ')) AS term FROM {posts}),
tf AS (SELECT {key}, term, count(*) AS tf FROM toks WHERE length(term) >= 2 AND term NOT IN {STOP_SQL} GROUP BY {key}, term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY tf DESC, term DESC) AS rk FROM tf),
joined AS (SELECT {key}, string_agg(term, ' ' ORDER BY rk) AS terms FROM ranked WHERE rk <= {TITLE_TERMS} GROUP BY {key})
SELECT s.{key}, s.num_tweets,
  CASE WHEN s.num_tweets < {MIN_EVENT_ROWS} THEN 'Small Event'
       WHEN j.terms IS NULL OR j.terms = '' THEN 'Generic Event'
       ELSE {title_case('j.terms')} END AS event_title
FROM sizes s LEFT JOIN joined j ON s.{key} = j.{key}"""


def LABEL_POSTS_FOR(folder: str, raw: str) -> str:  # noqa: N802
    return f"""WITH
docs AS (SELECT doc_id, {folder} AS folder, text FROM documents),
ids AS (SELECT folder, CAST(dense_rank() OVER (ORDER BY folder) - 1 AS BIGINT) AS event_id FROM (SELECT DISTINCT folder FROM docs)),
lp_all AS (
  SELECT d.doc_id, d.folder, {raw} AS raw_tweet, {clean_semantic(raw)} AS clean_text, ids.event_id
  FROM docs d JOIN ids ON d.folder = ids.folder WHERE d.text IS NOT NULL
),
labelled AS (
  SELECT raw_tweet, clean_text, event_id, replace(folder, '_', ' ') AS event_title, 'crisisnlp' AS source, doc_id
  FROM (SELECT *, row_number() OVER (PARTITION BY clean_text ORDER BY event_id, doc_id) AS rn
        FROM lp_all WHERE length(clean_text) > 10) WHERE rn = 1
)"""


LABEL_POSTS = LABEL_POSTS_FOR("source", "d.text")[len("WITH"):]


GROUPS = """
g AS (SELECT doc_id, source || '/' || lang AS grp FROM documents),
gs AS (SELECT grp, count(*) AS n FROM g GROUP BY grp),
gthr AS (SELECT greatest(10, CAST(floor(sum(n) * 0.001) AS BIGINT)) AS t FROM gs),
gkept AS (SELECT g.* FROM g WHERE grp IN (SELECT grp FROM gs WHERE n >= (SELECT t FROM gthr)))"""


EMB = f"""
es AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
ethr AS (SELECT greatest({MIN_GROUP_FLOOR}, CAST(floor(sum(n) * {MIN_GROUP_FRACTION}) AS BIGINT)) AS t FROM es),
ekept AS (SELECT * FROM embeddings WHERE label IN (SELECT label FROM es WHERE n >= (SELECT t FROM ethr))),
ecodes AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS cid FROM (SELECT DISTINCT label FROM ekept)),
ecoded AS (SELECT e.vec_id, e.label, c.cid, e.embedding FROM ekept e JOIN ecodes c ON e.label = c.label),
elong AS (
  SELECT cid, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM ecoded
),
emean AS (SELECT cid, dim, avg(v) AS mean FROM elong GROUP BY cid, dim),
enorm AS (SELECT cid, sqrt(sum(mean * mean)) AS nrm FROM emean GROUP BY cid),
ecent AS (SELECT m.cid, m.dim, m.mean, CASE WHEN n.nrm > 0 THEN m.mean / n.nrm ELSE m.mean END AS unit
          FROM emean m JOIN enorm n ON m.cid = n.cid),
evec AS (SELECT cid, list(unit ORDER BY dim) AS u FROM ecent GROUP BY cid),
epairs AS (
  SELECT a.cid AS src, b.cid AS dst, round(list_inner_product(a.u, b.u), 9) AS sim
  FROM evec a JOIN evec b ON a.cid <> b.cid
),
edges AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst ASC) AS rank FROM epairs)
  WHERE rank <= {NEIGHBOURS}
),
ethreshold AS (SELECT round(quantile_cont(sim, {THRESHOLD_QUANTILE}), 9) AS threshold FROM edges),
estrong AS (SELECT src, dst FROM edges WHERE sim > (SELECT threshold FROM ethreshold)),
eund AS (SELECT src AS a, dst AS b FROM estrong UNION SELECT dst, src FROM estrong),
ecomp AS (
  SELECT id AS cid, min(r) AS component FROM (
    WITH RECURSIVE reach(id, r) AS (
      SELECT cid, cid FROM evec
      UNION
      SELECT reach.id, eund.b FROM reach JOIN eund ON reach.r = eund.a
    ) SELECT * FROM reach
  ) GROUP BY id
),
erenum AS (
  SELECT c.cid, CAST(dense_rank() OVER (ORDER BY c.component) - 1 AS BIGINT) AS event_id FROM ecomp c
)"""


COHERENCE = f"""
csizes AS (SELECT source, count(*) AS num_tweets FROM posts GROUP BY source HAVING count(*) >= {MIN_EVENT_ROWS}),
ctoks AS (
  SELECT source, doc_id, term FROM (
    SELECT source, doc_id, unnest(string_split(clean_text, ' ')) AS term FROM posts WHERE source IN (SELECT source FROM csizes)
  ) WHERE length(term) >= 2 AND term NOT IN {STOP_SQL}
),
ctf AS (SELECT source, term, count(*) AS tf FROM ctoks GROUP BY source, term),
cvocab AS (
  SELECT source, term FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tf DESC, term ASC) AS r FROM ctf)
  WHERE r <= {COHERENCE_MAX_TERMS}
),
cpresent AS (SELECT DISTINCT t.source, t.doc_id, t.term FROM ctoks t JOIN cvocab v ON t.source = v.source AND t.term = v.term),
cdoc AS (SELECT source, doc_id, count(*) AS m FROM cpresent GROUP BY source, doc_id),
cs AS (SELECT p.source, p.term, CAST(sum(d.m) AS DOUBLE) AS s FROM cpresent p JOIN cdoc d
       ON p.source = d.source AND p.doc_id = d.doc_id GROUP BY p.source, p.term),
cscore AS (SELECT source, sum(s / (s + {COHERENCE_EPS})) / pow(count(*), 2) AS c FROM cs GROUP BY source),
coh AS (SELECT z.source, z.num_tweets, coalesce(c.c, 0.0) AS coherence FROM csizes z LEFT JOIN cscore c ON z.source = c.source)"""


def _decorated_select(expr_of_raw: str, name: str = "clean_text") -> str:
    return f"WITH d AS ({DECORATED}) SELECT doc_id, {expr_of_raw} AS {name} FROM d"


def _features_sql(source: str = DECORATED, carry: str = "doc_id") -> str:
    c = "clean_text"
    return f"""WITH d AS ({source}), f AS (SELECT *, {clean_display('raw_text')} AS clean_text FROM d)
SELECT {carry}, clean_text,
  CAST(len(regexp_extract_all({c}, '{COUNTED_EMOJI}')) AS BIGINT) AS emoji_count,
  CAST({count_char(c, '!')} AS BIGINT) AS exclamation_count,
  CAST({count_char(c, '?')} AS BIGINT) AS question_count,
  CAST(coalesce({count_char('raw_text', '#')}, 0) AS BIGINT) AS hashtag_count,
  CAST({upper_words('raw_text')} AS BIGINT) AS uppercase_word_count,
  CAST(length({c}) AS BIGINT) AS tweet_length,
  CAST(CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ' ')) END AS BIGINT) AS word_count
FROM f WHERE trim(clean_text) <> ''"""


def _date_strings_sql() -> str:
    # what each layout keeps of the time: layouts 4 and 5 the day, 6 the minute, the others the second
    return """dp AS (
  SELECT event_id, CASE WHEN event_id % 8 IN (4, 5) THEN date_trunc('day', ts)
    WHEN event_id % 8 = 6 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS ts FROM events
)"""


def window_sql(ts: str) -> str:
    monday = f"CAST(date_trunc('week', {ts}) AS DATE)"
    return f"strftime({monday}, '%Y-%m-%d') || '/' || strftime({monday} + INTERVAL 6 DAY, '%Y-%m-%d')"


def _tfidf_sql() -> str:
    dim = cat.TFIDF_DIM
    return f"""WITH docs AS (SELECT doc_id, {clean_semantic('text')} AS clean_text FROM documents),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM docs),
toks AS (SELECT doc_id, unnest(string_split(clean_text, ' ')) AS term FROM docs),
kept AS (SELECT doc_id, CAST(CAST(('0x' || substr(md5(term), 1, 8)) AS UBIGINT) % {dim} AS BIGINT) AS bucket
         FROM toks WHERE length(term) >= 2 AND term NOT IN {STOP_SQL}),
tf AS (SELECT doc_id, bucket, CAST(count(*) AS DOUBLE) AS tf FROM kept GROUP BY doc_id, bucket),
df AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY bucket),
w AS (SELECT tf.doc_id, tf.bucket, tf.tf * ln(((SELECT n FROM n) + 1.0) / (df.df + 1.0)) AS w FROM tf JOIN df ON tf.bucket = df.bucket),
nw AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS nrm FROM w)
SELECT doc_id, bucket, round(CASE WHEN nrm > 0 THEN w / nrm ELSE 0.0 END, {cat.VEC_DECIMALS}) AS weight FROM nw"""


def _silhouette_sql(squared: bool = True) -> str:
    dist = "pow(list_distance(a.v, b.v), 2)" if squared else "list_distance(a.v, b.v)"
    return """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sizes AS (SELECT label, count(*) AS n FROM e GROUP BY label),
pd AS (
  SELECT a.vec_id, a.label AS la, b.label AS lb, avg(DIST) AS d
  FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY a.vec_id, a.label, b.label
),
ab AS (
  SELECT vec_id, la,
    max(CASE WHEN lb = la THEN d END) AS a,
    min(CASE WHEN lb <> la THEN d END) AS b
  FROM pd GROUP BY vec_id, la
),
s AS (
  SELECT CASE WHEN z.n = 1 OR ab.a IS NULL THEN 0.0 ELSE (ab.b - ab.a) / greatest(ab.a, ab.b) END AS s
  FROM ab JOIN sizes z ON ab.la = z.label
)
SELECT round(avg(s), 9) AS silhouette FROM s""".replace("DIST", dist)


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["source_titles"] = f"WITH {CLEAN_POSTS}, {titles_sql('posts', 'source')}"
    q["clean_semantic"] = _decorated_select(clean_semantic("raw_text"))
    q["clean_emotion"] = _decorated_select(clean_emotion("raw_text"))
    q["clean_display"] = _decorated_select(clean_display("raw_text"))
    for name, step in STEPS.items():
        q[name] = _decorated_select(step("raw_text"))
    q["repair_encoding"] = "SELECT doc_id, text FROM documents"
    q["repair_cp1252"] = "SELECT doc_id, text FROM documents"  # the repair must give the original back
    mixed = "'😔 привет “' || text || '” 東京 ' || text || ' 🚀 naïve €'"
    q["repair_mixed"] = f"SELECT doc_id, {mixed} AS text FROM documents"
    q["display_mixed"] = (
        f"SELECT doc_id, {clean_display('raw')} AS clean_text FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {mixed} "
        "ELSE 'RT @ö: «' || text || '» !!!!!' END AS raw FROM documents)"
    )
    q["emotion_features"] = _features_sql()
    q["encoding_suspects"] = (
        # Spark repairs the double encoding once, which leaves the single encoding; the oracle starts there.
        f"SELECT * FROM (SELECT doc_id, {clean_display(mojibake('text'))} AS clean_text FROM documents) "
        "WHERE regexp_matches(clean_text, '[ðâÃ�]')"
    )
    em = clean_display("raw_text")
    q["emotion_report"] = (
        f"WITH r AS ({DECORATED}), d AS (SELECT doc_id, raw_text FROM r UNION ALL SELECT doc_id, '@only_a_mention' FROM r WHERE doc_id % 5 = 0) SELECT count(*) AS rows_before, "
        f"CAST(count(*) FILTER (WHERE trim({em}) <> '') AS BIGINT) AS rows_after, "
        f"CAST(count(*) FILTER (WHERE trim({em}) = '') AS BIGINT) AS removed FROM d"
    )
    q["encoding_audit"] = (
        f"SELECT CAST(count(*) FILTER (WHERE regexp_matches({clean_display(mojibake('text'))}, '[ðâÃ�]')) AS BIGINT) AS suspects, "
        "count(*) AS rows FROM documents"
    )
    q["null_tokens"] = (
        "SELECT doc_id, text FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, "
        "CASE doc_id % 7 WHEN 0 THEN 'NA' WHEN 1 THEN 'null' ELSE '' END FROM documents WHERE doc_id % 7 < 3) "
        "WHERE text IS NOT NULL AND text NOT IN ("
        + ", ".join("'" + t + "'" for t in PANDAS_NA_TOKENS)
        + ")"
    )
    q["event_name_from_path"] = "SELECT page_id, coalesce(regexp_extract(url, '([^/]*)/+[^/]*$', 1), '') AS event_name FROM pages"
    q["title_from_name"] = "SELECT doc_id, replace(concat_ws('_', source, lang), '_', ' ') AS event_title FROM documents"
    q["resolve_conform"] = (
        "SELECT text AS raw_text, CAST(-1 AS BIGINT) AS event_id, 'Unknown Event' AS event_title, 'documents' AS dataset_name FROM documents "
        "UNION ALL SELECT text, CAST(-1 AS BIGINT), 'Unknown Event', 'benchmark' FROM benchmark"
    )
    q["merge_datasets"] = f"""WITH {LABEL_POSTS},
u AS (
  SELECT raw_tweet AS raw_text, event_id, event_title, 'crisisnlp' AS dataset_name, 0 AS rk, event_id AS o1, doc_id AS o2 FROM labelled
  UNION ALL SELECT text, conv_id, 'Unknown Event', 'corona', 1, conv_id, turn FROM conversations
  UNION ALL SELECT text, CAST(-1 AS BIGINT), 'Unknown Event', 'sentiment140', 2, item_id, 0 FROM benchmark
)
SELECT raw_text, event_id, event_title, dataset_name, dataset_name || '_' || CAST(event_id AS VARCHAR) AS global_event_id
FROM (SELECT *, row_number() OVER (PARTITION BY raw_text ORDER BY rk, o1, o2) AS rn FROM u WHERE raw_text IS NOT NULL)
WHERE rn = 1"""
    q["label_posts"] = f"WITH {LABEL_POSTS} SELECT raw_tweet, clean_text, event_id, event_title, source FROM labelled"
    na = ", ".join("'" + t + "'" for t in PANDAS_NA_TOKENS)
    q["merge_then_enrich"] = _features_sql(q["merge_datasets"], "raw_text, event_id, event_title, dataset_name, global_event_id")
    q["export_events"] = (
        f"SELECT text AS raw_text, {clean_semantic('text')} AS clean_text, {clean_emotion('text')} AS emotion_text, "
        "doc_id AS event_id, source AS event_title, 'global' AS time_window FROM documents"
    )
    q["reduce_neighbours_check"] = (
        "SELECT count(*) AS num_rows, CAST(10 AS BIGINT) AS min_width, CAST(10 AS BIGINT) AS max_width, true AS truer_than_pca FROM embeddings"
    )
    q["assign_events_layout"] = "SELECT count(*) AS num_rows, CAST(0 AS BIGINT) AS differing FROM embeddings"
    q["knn_graph_check"] = "SELECT count(*) AS num_rows, CAST(0 AS BIGINT) AS own, true AS recall_reached FROM embeddings"
    q["reduce_dims_check"] = (
        "SELECT count(*) AS num_rows, CAST(10 AS BIGINT) AS min_width, CAST(10 AS BIGINT) AS max_width, true AS falling FROM embeddings"
    )
    q["assign_events_check"] = (
        "SELECT count(*) AS num_rows, CAST(0 AS BIGINT) AS not_nearest, CAST(0 AS BIGINT) AS out_of_range FROM embeddings"
    )
    q["csv_roundtrip"] = f"SELECT doc_id, CASE WHEN text IN ({na}) THEN NULL ELSE text END AS text, source FROM documents"
    # folders are 'source=<name>'; the Latin-1 read double-encodes raw text but not its semantic clean text
    q["tsv_ingest"] = (
        LABEL_POSTS_FOR("'source=' || source", mojibake("d.text"))
        + " SELECT raw_tweet, clean_text, event_id, event_title, source FROM labelled"
    )
    q["typed_csv"] = """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN event_id % 5 <> 0 THEN user_id END AS user_id, round(value, 6) AS value,
  event_id % 2 = 0 AS even, CASE event_id % 1000 WHEN 7 THEN NULL WHEN 8 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS mixed,
  CAST(NULL AS VARCHAR) AS nothing, event_type, event_id * 2 AS double_id FROM events"""
    # a column of events is of its own type again; ``mixed`` has words in it, ``nothing`` no value
    q["typed_schema"] = """SELECT * FROM (VALUES ('event_id', 'bigint'), ('ts', 'timestamp_ntz'), ('user_id', 'bigint'), ('value', 'double'), ('even', 'boolean'),
  ('mixed', 'string'), ('nothing', 'string'), ('event_type', 'string')) AS t(name, kind) WHERE (SELECT count(*) FROM events) > 0"""
    kind = "((ascii(source) + length(source)) % 4)"
    long_row = "doc_id % 11 = 3"
    raw = mojibake("text")
    q["tsv_ingest_mixed"] = f"""WITH
docs AS (SELECT doc_id, 'source=' || source AS folder, {kind} AS kind, text FROM documents WHERE text IS NOT NULL),
ids AS (SELECT folder, CAST(dense_rank() OVER (ORDER BY folder) - 1 AS BIGINT) AS event_id FROM (SELECT DISTINCT folder FROM docs)),
kept AS (
  SELECT d.doc_id, d.folder, {raw} AS raw_tweet, {clean_semantic(raw)} AS clean_text, ids.event_id FROM docs d JOIN ids USING (folder)
  WHERE kind <> 3 AND NOT ({long_row}) AND doc_id % 13 <> 5)
SELECT raw_tweet, clean_text, event_id, replace(folder, '_', ' ') AS event_title, 'crisisnlp' AS source
FROM (SELECT *, row_number() OVER (PARTITION BY clean_text ORDER BY event_id, doc_id) AS rn FROM kept WHERE length(clean_text) > 10) WHERE rn = 1"""
    q["tsv_ledger"] = f"""SELECT 'source=' || source AS folder, reason, CAST(count(*) AS BIGINT) AS rows FROM (
  SELECT source, CASE WHEN {kind} = 3 THEN 'no text column' WHEN {long_row} THEN 'too many fields' WHEN doc_id % 13 = 5 THEN 'missing text' END AS reason
  FROM documents WHERE text IS NOT NULL) WHERE reason IS NOT NULL GROUP BY source, reason"""
    q["dedupe_first"] = f"""SELECT doc_id, clean_text FROM (
  SELECT doc_id, clean_text, row_number() OVER (PARTITION BY clean_text ORDER BY doc_id) AS rn
  FROM (SELECT doc_id, {clean_semantic('text')} AS clean_text FROM documents)) WHERE rn = 1"""
    cs = clean_semantic("text")
    q["stage_report"] = f"""SELECT count(*) AS n_rows, count(text) AS n_text,
  CAST(count(*) FILTER (WHERE text IS NOT NULL AND length({cs}) > 10) AS BIGINT) AS n_long,
  count(DISTINCT CASE WHEN text IS NOT NULL AND length({cs}) > 10 THEN {cs} END) AS n_unique,
  count(DISTINCT source) AS n_sources FROM documents"""
    q["event_stats"] = f"WITH {LABEL_POSTS} SELECT count(DISTINCT event_id) AS total_events, count(*) AS total_tweets FROM labelled"
    q["top_events"] = (
        f"WITH {LABEL_POSTS} SELECT event_id, count(*) AS num_tweets FROM labelled GROUP BY event_id "
        "ORDER BY num_tweets DESC, event_id ASC LIMIT 10"
    )
    q["peek_rows"] = (
        f"WITH d AS ({DECORATED}), f AS (SELECT doc_id, raw_text, {clean_display('raw_text')} AS clean_text FROM d) "
        "SELECT doc_id, raw_text, clean_text FROM f WHERE trim(clean_text) <> '' ORDER BY doc_id LIMIT 5"
    )
    q["sample_n"] = (
        f"SELECT doc_id, source FROM documents ORDER BY md5('{cat.SAMPLE_SEED}' || CAST(doc_id AS VARCHAR)), doc_id "
        f"LIMIT {cat.SAMPLE_SIZE}"
    )
    q["parse_dates"] = (
        f"WITH {_date_strings_sql()} SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed, "
        f"{window_sql('ts')} AS time_window FROM dp WHERE ts IS NOT NULL"
    )
    units = ("second", "minute", "day", "day", "minute", "second", "minute", "day", "day", "day", "second", "second", "second", "month")
    cut = " UNION ALL ".join(f"SELECT event_id, {i} AS column_no, date_trunc('{unit}', ts) AS t FROM events" for i, unit in enumerate(units))
    q["date_layouts"] = f"SELECT event_id, column_no, strftime(t, '%Y-%m-%d %H:%M:%S') AS parsed, {window_sql('t')} AS time_window FROM ({cut})"
    q["date_rejects"] = (
        "SELECT -1 - event_id AS event_id, CASE event_id % 4 WHEN 0 THEN '31/02/2020' WHEN 1 THEN '2020.01.31' ELSE 'week ' || event_id END AS date, "
        "CASE event_id % 4 WHEN 1 THEN 'another layout' ELSE 'no layout' END AS reason FROM events WHERE event_id % 4 <> 3"
    )
    q["time_window"] = f"SELECT event_id, {window_sql('ts')} AS time_window FROM events"
    q["weekly_counts"] = (
        f"SELECT {window_sql('ts')} AS time_window, event_type, count(*) AS num_posts FROM events "
        "WHERE ts IS NOT NULL GROUP BY 1, 2"
    )
    q["weekly_orders"] = (
        f"SELECT {window_sql('o_orderdate')} AS time_window, o_orderstatus, count(*) AS num_posts FROM orders "
        "WHERE o_orderdate IS NOT NULL GROUP BY 1, 2"
    )
    q["no_date_window"] = f"WITH {CLEAN_POSTS} SELECT doc_id, 'global' AS time_window FROM posts"
    q["filter_small_groups"] = f"WITH {GROUPS} SELECT doc_id, grp FROM gkept"
    q["dense_codes"] = (
        f"WITH {GROUPS} SELECT grp, CAST(dense_rank() OVER (ORDER BY grp) - 1 AS BIGINT) AS code "
        "FROM (SELECT DISTINCT grp FROM gkept)"
    )
    q["centroids"] = f"WITH {EMB} SELECT cid, dim, round(mean, 9) AS mean, round(unit, 9) AS unit FROM ecent"
    q["knn_edges"] = f"WITH {EMB} SELECT src, dst, sim, CAST(rank AS BIGINT) AS rank FROM edges"
    q["adaptive_threshold"] = f"WITH {EMB} SELECT threshold FROM ethreshold"
    q["connected_components"] = f"WITH {EMB} SELECT cid, component FROM ecomp"
    q["renumber_events"] = f"WITH {EMB} SELECT cid, event_id FROM erenum"
    q["merge_events"] = f"WITH {EMB} SELECT e.vec_id, e.label, r.event_id FROM ecoded e JOIN erenum r ON e.cid = r.cid"
    q["term_counts"] = (
        f"WITH {CLEAN_POSTS}, toks AS (SELECT source, unnest(string_split(clean_text, ' ')) AS term FROM posts) "
        f"SELECT source, term, count(*) AS tf FROM toks WHERE length(term) >= 2 AND term NOT IN {STOP_SQL} GROUP BY source, term"
    )
    q["title_events"] = (
        f"WITH {EMB}, {CLEAN_POSTS}, merged AS (SELECT e.vec_id AS doc_id, r.event_id FROM ecoded e JOIN erenum r ON e.cid = r.cid), "
        f"mposts AS (SELECT p.*, m.event_id FROM posts p JOIN merged m ON p.doc_id = m.doc_id), "
        f"{titles_sql('mposts', 'event_id')}"
    )
    labels = (
        f"{EMB}, {CLEAN_POSTS}, merged AS (SELECT e.vec_id AS doc_id, r.event_id FROM ecoded e JOIN erenum r ON e.cid = r.cid), "
        "mposts AS (SELECT p.*, m.event_id FROM posts p JOIN merged m ON p.doc_id = m.doc_id)"
    )
    by_event = COHERENCE.replace("source", "event_id").replace("FROM posts", "FROM mposts")
    q["discover_from_labels"] = (
        f"WITH {labels}, named AS (WITH {titles_sql('mposts', 'event_id')}) SELECT p.doc_id, p.clean_text, {clean_emotion('p.raw_text')} AS emotion_text, "
        "p.event_id, n.event_title, 'global' AS time_window FROM mposts p JOIN named n ON p.event_id = n.event_id"
    )
    q["discover_from_labels_coherence"] = f"WITH {labels}, {by_event} SELECT event_id, num_tweets, round(coherence, {cat.COHERENCE_DECIMALS}) AS coherence FROM coh"
    q["discover_from_labels_summary"] = (
        f"WITH {labels}, {by_event} SELECT (SELECT count(DISTINCT event_id) FROM mposts) AS total_events, (SELECT count(*) FROM mposts) AS total_tweets, "
        "(SELECT CAST(count(*) > 0 AS BIGINT) FROM mposts) AS time_windows, "
        f"(SELECT round(avg(coherence), {cat.COHERENCE_DECIMALS}) FROM coh) AS mean_coherence, (SELECT count(*) FROM coh) AS scored_events, true AS silhouette_within_bound"
    )
    q["discover_stages"] = (
        f"WITH {CLEAN_POSTS} SELECT 'read' AS stage, count(*) AS num_rows FROM documents UNION ALL "
        "SELECT s, (SELECT count(*) FROM posts) FROM (VALUES ('clean'), ('sampled'), ('clustered')) AS t(s)"
    )
    q["topic_coherence"] = (
        f"WITH {CLEAN_POSTS}, {COHERENCE} SELECT source, num_tweets, round(coherence, {cat.COHERENCE_DECIMALS}) AS coherence FROM coh"
    )
    q["mean_coherence"] = (
        f"WITH {CLEAN_POSTS}, {COHERENCE} SELECT round(avg(coherence), {cat.COHERENCE_DECIMALS}) AS mean_coherence, "
        "count(*) AS scored_events FROM coh"
    )
    q["hashed_tfidf"] = _tfidf_sql()
    q["silhouette_sq"] = _silhouette_sql(squared=True)
    q["silhouette_exact"] = _silhouette_sql(squared=False)
    return q
