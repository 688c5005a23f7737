"""Queries of transcript mining."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgrade.functions import text as X
from loomgrade.functions.fixed import PREFERENCE_PHRASES, REFUSED_PREFIXES, SALIENCE_PHRASES, SCOPING_PHRASES
from loomgrade.operators import reduction as D
from loomgrade.operators import service as V
from loomgrade.operators import transcripts as T
from loomgrade.plans import bindings as B
from loomgrade.session import materialise, table

BY = ["session_id", "win"]


def session_events(spark, sf):
    """Events as typed session events: what each type becomes, and phrases, tools and outcomes by number."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "assistant").when(F.col("event_type") == "signup", "user").when(F.col("event_type") == "click", "tool_call").when(F.col("event_type") == "error", "tool_result").otherwise("file_edit")
    said = F.when(i % 13 == 0, "Always run the tests. Use tabs here! Thanks").when(i % 17 == 0, "I want it plain.\nnever guess").otherwise("please look at it")
    tool = F.element_at(F.array(F.lit("Bash"), F.lit("Read"), F.lit("Edit")), (i % 3 + 1).cast("int"))
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = e.select(F.col("user_id").alias("session_id"), order.alias("position"), i.alias("event_id"), kind.alias("kind"), "value", said.alias("content"), F.concat(F.lit("t"), (i % 4).cast("string")).alias("tool_use_id"), tool.alias("name"), (F.col("value") > 70).alias("is_error"))
    rows = rows.withColumn("win", F.floor(F.col("position") / 8).cast("bigint"))
    rows = rows.withColumn("exit_code", F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 2).cast("int")))
    return rows.withColumn("path", F.concat(F.lit("/repo/f"), (F.col("event_id") % 9).cast("string"), F.lit(".rs"))).withColumn("operation", F.lit("Edit")).withColumn("input_json", F.concat(F.lit('{"command": "run '), F.col("event_id").cast("string"), F.lit('", "a": "b"}'))).withColumn("output", F.lit(""))


def _jsonl(spark, sf):
    c = table(spark, sf, "conversations")
    text = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    user = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(F.col("text").alias("content")).alias("message")))
    assistant = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.array(text).alias("content")).alias("message")))
    other = F.to_json(F.struct(F.col("role").alias("type")))
    line = F.when(F.col("turn") == 3, "{not json").when(F.col("role") == "user", user).when(F.col("role") == "assistant", assistant).otherwise(other)
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("line"), line.alias("json"))


def typed_events(spark, sf):
    return T.parse_events(_jsonl(spark, sf)).select("session_id", "line", "part", "kind", F.md5("content").alias("content"), "malformed")


def conversational_projection(spark, sf):
    return T.conversational(session_events(spark, sf)).groupBy("session_id", "kind").agg(F.count("*").alias("n"))


def token_estimate(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.token_estimate(F.col("text")).alias("tokens"))


def budget_windows(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("position"), X.token_estimate(F.col("text")).alias("tokens"))
    return T.budget_windows(c, 300, 1).withColumnRenamed("window", "win")


def salience_flags(spark, sf):
    return T.salience(session_events(spark, sf), BY).select(*BY, "resolved_arc", "preference", "failure", "file_edit", "bash")


def salience_score(spark, sf):
    return T.salience(session_events(spark, sf), BY).select(*BY, "score", "hard_keep", "reason")


def resolved_error_arc(spark, sf):
    return T.salience(session_events(spark, sf), BY).where("resolved_arc").select(*BY)


def gate_threshold(spark, sf):
    return T.gate_threshold(T.salience(session_events(spark, sf), BY), 0.75).select(*BY, "score")


def gate_topk(spark, sf):
    return T.gate_topk(T.salience(session_events(spark, sf), BY), 2, "session_id", "win").select(*BY, "score", "hard_keep")


def preference_sentences(spark, sf):
    return T.preferences(session_events(spark, sf), ["session_id"])


def preference_candidates(spark, sf):
    return T.preference_candidates(T.preferences(session_events(spark, sf), ["session_id"]), ["session_id"])


def plurality_vote(spark, sf):
    return T.plurality(session_events(spark, sf).where("kind = 'tool_call'"), ["session_id"], "name", "position")


def preamble_facts(spark, sf):
    return T.salient_paths(session_events(spark, sf), ["session_id"], 5).select("session_id", F.array_join("paths", ",").alias("paths"))


def _work(spark, sf):
    """Sessions' events with paths and commands of several languages and repositories."""
    i = F.col("event_id")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % n + 1).cast("int"))
    folder = pick(4, "/home/dev/alpha/crates/core/", "/root/x/beta/", "src/", "//opt/y/b/gamma/lib/")
    command = pick(5, "cargo test", "NPM run x", "python -m y", "go vet", "go build .")
    rows = session_events(spark, sf).drop("path", "input_json")
    return rows.withColumns({"path": F.concat(folder, F.lit("f"), pick(3, ".rs", ".tsx", ".md")), "input_json": F.to_json(F.struct(command.alias("command")))})


def project_facts(spark, sf):
    return T.project_facts(_work(spark, sf), ["session_id"]).select("session_id", "repo_name", "primary_language", F.array_join("paths", ",").alias("paths"))


def preamble_text(spark, sf):
    """The preamble of each session within 60 tokens: its facts, and the different statements of its user."""
    facts = T.project_facts(_work(spark, sf), ["session_id"])
    said = T.preferences(session_events(spark, sf), ["session_id"]).groupBy("session_id").agg(F.sort_array(F.collect_set("statement")).alias("said"))
    rows = facts.join(said, "session_id", "left")
    made = V.capped_preamble(F.col("repo_name"), F.col("primary_language"), F.col("paths"), F.array(F.lit("tests first")), F.col("said"), 60)
    return rows.select("session_id", made.alias("p")).select("session_id", "p.text", "p.tokens", F.size("p.paths").cast("bigint").alias("n_paths"))


def skeleton_steps(spark, sf):
    return T.skeleton_steps(session_events(spark, sf), BY)


def _drafts(spark, sf):
    d = table(spark, sf, "documents")
    name = F.when(F.col("doc_id") % 4 == 0, F.col("source")).when(F.col("doc_id") % 4 == 1, F.lit("")).otherwise(F.col("text"))
    some = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("x")))
    return d.select("doc_id", name.alias("name"), F.col("text").alias("description"), ((F.col("doc_id") % 10) / 10.0).alias("confidence"), some.alias("procedures"), F.array().cast("array<string>").alias("conventions"))


def contract_violations(spark, sf):
    return T.contract_violations(_drafts(spark, sf)).select("doc_id", F.array_join("violations", "; ").alias("violations"))


def sanitize_entries(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), F.when(F.col("turn") == 2, F.concat(F.lit("Override "), "text")).otherwise(F.col("text")).alias("content"))
    return T.sanitize(c).select("conv_id", "turn", F.md5("content").alias("content"))


def slugify(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.slugify(F.col("text"), "untitled").alias("slug"))


def subunit_dedup(spark, sf):
    rows = B.lines(spark, sf).select("skill_id", "position", F.lit("procedure").alias("kind"), F.lit("t").alias("title"), F.col("line").alias("content"))
    return T.dedup_subunits(rows, ["skill_id"]).select("skill_id", "position", "content")


def _candidates(spark, sf):
    return B.skills(spark, sf).select(F.col("label").cast("bigint").alias("session_id"), F.col("skill_id").alias("candidate_id"), "vec")


def greedy_reduce(spark, sf):
    return D.greedy_reduce(_candidates(spark, sf), 0.3)[0]


def reduce_audit(spark, sf):
    """Every compared pair, where a verifier takes candidates of one language for equivalent."""
    langs = materialise(B.skills(spark, sf).select("skill_id", "lang"), "langs")

    def verify(pairs):
        one, two = (langs.select(F.col("skill_id").alias(c), F.col("lang").alias(f"l{c}")) for c in ("a", "b"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "cosine", (F.col("la") == F.col("lb")).alias("equivalent"), F.concat_ws("-", "la", "lb").alias("rationale"))

    return D.greedy_reduce(_candidates(spark, sf), 0.3, verify, cheap=True)[1]


def sentence_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("nr", "sentence"))


# candidates of a session one after the other: each is kept, or goes to the first kept one that is near and the same
REDUCE = f"""WITH RECURSIVE {B.SKILLS}, near AS (SELECT * FROM (SELECT a.skill_id AS a, b.skill_id AS b, a.lang AS la, b.lang AS lb, round({B.cosine_sql('a.vec', 'b.vec')}, 6) AS c FROM sk a JOIN sk b ON a.label = b.label AND a.skill_id < b.skill_id) WHERE c >= 0.3),
ea AS (SELECT b, list(a) AS l FROM near WHERE {{same}} GROUP BY b),
cd AS (SELECT label::BIGINT AS s, skill_id, row_number() OVER (PARTITION BY label ORDER BY skill_id) AS n, coalesce(l, []) AS l FROM sk LEFT JOIN ea ON b = skill_id),
st AS (SELECT s, n, [skill_id] AS kept, skill_id AS id, skill_id AS kept_by FROM cd WHERE n = 1 UNION ALL
  SELECT s, n, CASE WHEN m IS NULL THEN list_append(kept, skill_id) ELSE kept END, skill_id, coalesce(m, skill_id)
  FROM (SELECT st.kept, cd.*, list_min(list_intersect(st.kept, cd.l)) AS m FROM st JOIN cd ON cd.s = st.s AND cd.n = st.n + 1))"""
ANY = lambda c, ps: "(" + " OR ".join(f"contains({c}, '{p.replace(chr(39), chr(39) * 2)}')" for p in ps) + ")"
LOW = B.LOWER.format
SE = """se AS (SELECT *, (position // 8)::BIGINT AS win FROM (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position, event_id,
  CASE event_type WHEN 'view' THEN 'assistant' WHEN 'signup' THEN 'user' WHEN 'click' THEN 'tool_call' WHEN 'error' THEN 'tool_result' ELSE 'file_edit' END AS kind,
  CASE WHEN event_id % 13 = 0 THEN 'Always run the tests. Use tabs here! Thanks' WHEN event_id % 17 = 0 THEN 'I want it plain.' || chr(10) || 'never guess' ELSE 'please look at it' END AS content,
  't' || (event_id % 4) AS tool_use_id, ['Bash', 'Read', 'Edit'][(event_id % 3 + 1)::INT] AS name, (value > 70 OR (event_id % 5 = 0 AND event_id % 2 = 1)) AS failed, '/repo/f' || (event_id % 9) || '.rs' AS path FROM events))"""
FACTS = """wk AS (SELECT *, ['/home/dev/alpha/crates/core/', '/root/x/beta/', 'src/', '//opt/y/b/gamma/lib/'][(event_id % 4 + 1)::INT] || 'f' || ['.rs', '.tsx', '.md'][(event_id % 3 + 1)::INT] AS file, (event_id % 5)::INT AS cmd FROM se),
vt AS (SELECT session_id, position, CASE WHEN kind = 'file_edit' THEN ['Rust', 'TypeScript', NULL][(event_id % 3 + 1)::INT] WHEN kind = 'tool_call' AND name = 'Bash' THEN ['Rust', 'TypeScript', 'Python', NULL, 'Go'][cmd + 1] END AS l FROM wk),
vo AS (SELECT session_id, l FROM (SELECT session_id, l, count(*) AS n, min(position) AS f FROM vt WHERE l IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, f DESC) = 1),
ed AS (SELECT session_id, position, CASE event_id % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'src' ELSE 'gamma' END AS repo,
  CASE event_id % 4 WHEN 0 THEN 'crates/core' WHEN 1 THEN 'beta/f' || ['.rs', '.tsx', '.md'][(event_id % 3 + 1)::INT] WHEN 2 THEN 'src/f' || ['.rs', '.tsx', '.md'][(event_id % 3 + 1)::INT] ELSE 'gamma/lib' END AS p FROM wk WHERE kind = 'file_edit'),
fc AS (SELECT session_id, arg_min(repo, position) AS repo_name, any_value(l) AS primary_language, coalesce(list_sort(list(DISTINCT p) FILTER (p IS NOT NULL))[1:10], []) AS paths
  FROM (SELECT DISTINCT session_id FROM se) LEFT JOIN ed USING (session_id) LEFT JOIN vo USING (session_id) GROUP BY 1)"""
SAL = f"""WITH {SE}, tl AS (SELECT session_id, win, tool_use_id, max_by(name, position) AS tool FROM se WHERE kind = 'tool_call' GROUP BY ALL),
st AS (SELECT se.*, coalesce(tool, 'unknown') AS tool FROM se LEFT JOIN tl USING (session_id, win, tool_use_id)),
sv AS (SELECT *, kind = 'tool_result' AND NOT failed AND coalesce(bool_or(kind = 'tool_result' AND failed) OVER (PARTITION BY session_id, win, tool ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS solved FROM st),
fl AS (SELECT session_id, win, bool_or(solved) AS resolved_arc, bool_or(kind = 'user' AND {ANY(LOW('content'), SALIENCE_PHRASES)}) AS preference, bool_or(kind = 'tool_result' AND failed) AS failure, bool_or(kind = 'file_edit') AS file_edit, bool_or(kind = 'tool_call' AND name = 'Bash') AS bash FROM sv GROUP BY ALL),
sl AS (SELECT *, round(least(0.6 * resolved_arc::INT + 0.55 * preference::INT + 0.35 * failure::INT + 0.3 * file_edit::INT + 0.15 * bash::INT, 1.0), 6)::DOUBLE AS score, resolved_arc OR preference AS hard_keep, CASE WHEN resolved_arc THEN 'resolved_error_arc' WHEN preference THEN 'stated_preference' END AS reason FROM fl)"""
PREF = f"""WITH {SE}, sn AS (SELECT session_id, position, unnest(regexp_extract_all(content, '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+')) AS s, generate_subscripts(regexp_extract_all(content, '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+'), 1) AS nr FROM se WHERE kind = 'user'),
pf AS (SELECT session_id, position, nr, trim(s, ' ' || chr(10)) AS statement FROM sn WHERE {ANY(LOW("trim(s, ' ' || chr(10))"), PREFERENCE_PHRASES)}),
pr AS (SELECT session_id, statement, CASE WHEN {ANY(LOW('statement'), SCOPING_PHRASES)} THEN 'uncertain' ELSE 'general' END AS generality FROM pf QUALIFY row_number() OVER (PARTITION BY session_id, lower(statement) ORDER BY position, nr) = 1)"""

QUERIES = {
    "typed_events": (typed_events, """SELECT conv_id AS session_id, turn AS line, 0 AS part, CASE WHEN turn = 3 OR role = 'user' THEN 'user' WHEN role = 'assistant' THEN 'assistant' ELSE 'metadata' END AS kind,
  md5(CASE WHEN turn = 3 THEN '[unparseable line 4]' WHEN role IN ('user', 'assistant') THEN trim(text) ELSE role END) AS content, turn = 3 AS malformed FROM conversations WHERE turn = 3 OR role NOT IN ('user', 'assistant') OR trim(text) <> ''"""),
    "conversational_projection": (conversational_projection, f"WITH {SE} SELECT session_id, kind, count(*) AS n FROM se WHERE kind IN ('user', 'assistant') GROUP BY ALL"),
    "token_estimate": (token_estimate, "SELECT conv_id, turn, greatest(strlen(text) // 4, 1)::BIGINT AS tokens FROM conversations"),
    "budget_windows": (budget_windows, """WITH RECURSIVE t AS (SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, sum(greatest(strlen(text) // 4, 1)) OVER (PARTITION BY conv_id ORDER BY turn) AS c, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
e AS (SELECT session_id, s, n, greatest(s + 1, coalesce(m, 0)) AS e FROM (SELECT a.session_id, a.p AS s, any_value(a.n) AS n, max(b.p + 1) FILTER (b.c - coalesce(z.c, 0) <= 300) AS m FROM t a JOIN t b ON a.session_id = b.session_id AND b.p >= a.p LEFT JOIN t z ON z.session_id = a.session_id AND z.p = a.p - 1 GROUP BY a.session_id, a.p)),
r AS (SELECT session_id, 0::BIGINT AS win, s AS first, e - s AS size, e, n FROM e WHERE s = 0 UNION ALL
  SELECT e.session_id, r.win + 1, e.s, e.e - e.s, e.e, e.n FROM r JOIN e ON e.session_id = r.session_id AND e.s = CASE WHEN r.size <= 1 THEN r.first + 1 ELSE r.e - 1 END WHERE r.e < r.n)
SELECT session_id, win, first::BIGINT AS first, size::BIGINT AS size FROM r"""),
    "salience_flags": (salience_flags, f"{SAL} SELECT * FROM fl"),
    "salience_score": (salience_score, f"{SAL} SELECT session_id, win, score, hard_keep, reason FROM sl"),
    "resolved_error_arc": (resolved_error_arc, f"{SAL} SELECT session_id, win FROM sl WHERE resolved_arc"),
    "gate_threshold": (gate_threshold, f"{SAL} SELECT session_id, win, score FROM sl WHERE hard_keep OR score >= 0.75"),
    "gate_topk": (gate_topk, f"{SAL} SELECT session_id, win, score, hard_keep FROM (SELECT *, row_number() OVER (PARTITION BY session_id, hard_keep ORDER BY score DESC, win) AS r FROM sl) WHERE hard_keep OR r <= 2"),
    "preference_sentences": (preference_sentences, f"{PREF} SELECT * FROM pr"),
    "preference_candidates": (preference_candidates, f"{PREF} SELECT session_id, array_to_string(string_split(statement, ' ')[1:8], ' ') || ' (preference)' AS name, statement AS description, 0.7::DOUBLE AS confidence, generality FROM pr"),
    "plurality_vote": (plurality_vote, f"WITH {SE} SELECT session_id, name, n AS votes FROM (SELECT session_id, name, count(*) AS n, min(position) AS f FROM se WHERE kind = 'tool_call' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, f DESC) = 1"),
    "project_facts": (project_facts, f"WITH {SE}, {FACTS} SELECT session_id, repo_name, primary_language, array_to_string(paths, ',') AS paths FROM fc"),
    "preamble_text": (preamble_text, f"""{PREF}, {FACTS}, sd AS (SELECT session_id, list_sort(list(DISTINCT statement)) AS said FROM pr GROUP BY 1),
ls AS (SELECT fc.*, coalesce(said, []) AS said, unnest(range(len(paths) + 2 + len(coalesce(said, [])))) AS d FROM fc LEFT JOIN sd USING (session_id)),
ct AS (SELECT *, greatest(len(paths) - d, 0) AS np, CASE WHEN d > len(paths) THEN 0 ELSE 1 END AS nc, len(said) - greatest(d - len(paths) - 1, 0) AS nf FROM ls),
rn AS (SELECT *, concat_ws(chr(10) || chr(10), CASE WHEN repo_name IS NOT NULL OR primary_language IS NOT NULL OR np + nc > 0 THEN '[Project facts]' || chr(10) || concat_ws(chr(10), 'Repo: ' || repo_name, 'Language: ' || primary_language,
  CASE WHEN np > 0 THEN 'Key paths: ' || array_to_string(paths[1:np], ', ') END, CASE WHEN nc > 0 THEN 'Convention: tests first' END) END,
  CASE WHEN nf > 0 THEN '[Standing user preferences]' || chr(10) || array_to_string(list_transform(said[1:nf], lambda x: '- ' || trim(x)), chr(10)) END) AS text FROM ct)
SELECT session_id, text, ((strlen(text) + 3) // 4)::BIGINT AS tokens, np::BIGINT AS n_paths FROM rn WHERE strlen(text) <= 240 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY d) = 1"""),
    "preamble_facts": (preamble_facts, f"WITH {SE} SELECT session_id, array_to_string(list_sort(list(DISTINCT path))[1:5], ',') AS paths FROM se WHERE kind = 'file_edit' GROUP BY 1"),
    "skeleton_steps": (skeleton_steps, f"""WITH {SE}, tr AS (SELECT *, min(position) FILTER (kind = 'tool_result' AND failed) OVER (PARTITION BY session_id, win) AS f FROM se),
ar AS (SELECT *, max(position) FILTER (kind = 'tool_result' AND failed) OVER (PARTITION BY session_id, win) AS bad, max(position) FILTER (kind = 'tool_result' AND NOT failed) OVER (PARTITION BY session_id, win) AS good FROM tr WHERE position > f),
sp AS (SELECT * FROM ar WHERE kind IN ('file_edit', 'tool_call') AND (good IS NULL OR coalesce(bad, -1) > good OR position <= good) QUALIFY row_number() OVER (PARTITION BY session_id, win, tool_use_id ORDER BY kind <> 'file_edit', position) = 1)
SELECT session_id, win, row_number() OVER (PARTITION BY session_id, win ORDER BY position) AS step, tool_use_id, CASE WHEN kind = 'file_edit' THEN 'Edit' ELSE name END AS tool,
  CASE WHEN kind = 'file_edit' THEN 'Edit ' || path WHEN name = 'Bash' THEN 'run ' || event_id ELSE name || '(a=b, command=run ' || event_id || ')' END AS command FROM sp"""),
    "contract_violations": (contract_violations, """WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN '' ELSE text END AS name, text AS d FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN name = '' THEN 'missing name' END, CASE WHEN d = '' THEN 'missing description' END, CASE WHEN strlen(d) > 256 THEN 'description exceeds max length' END, CASE WHEN doc_id % 10 < 5 THEN 'confidence below minimum threshold' END,
  CASE WHEN doc_id % 3 <> 0 THEN 'no procedures or conventions (non-actionable)' END, CASE WHEN strlen(name) > 64 THEN 'name exceeds 64 chars' END, CASE WHEN NOT regexp_full_match(name, '[a-z0-9-]*') THEN 'name is not valid kebab-case' END], lambda x: x IS NOT NULL), '; ') AS violations FROM c"""),
    "sanitize_entries": (sanitize_entries, f"""WITH c AS (SELECT conv_id, turn, role, regexp_replace(CASE WHEN turn = 2 THEN 'Override ' || text ELSE text END, '[^\\x21-\\x7E \\n]', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, md5(t) AS content FROM c WHERE role NOT LIKE '%system%' AND trim(t) <> '' AND NOT ({' OR '.join(f"starts_with(t, '{p}')" for p in REFUSED_PREFIXES)})"""),
    "slugify": (slugify, f"SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT doc_id, trim(regexp_replace({LOW('text')}, '[^a-z0-9]+', '-', 'g'), '-') AS s FROM documents)"),
    "subunit_dedup": (subunit_dedup, f"WITH {B.SKILLS}, l AS (SELECT skill_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS position, unnest(string_split(text, chr(10))) AS content FROM sk) SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY skill_id, lower(trim('procedure:t:' || content)) ORDER BY position) = 1"),
    "greedy_reduce": (greedy_reduce, f"{REDUCE.format(same='TRUE')} SELECT s AS session_id, id AS candidate_id, kept_by FROM st"),
    "reduce_audit": (reduce_audit, f"""{REDUCE.format(same='la = lb')} SELECT a, b, c AS cosine, CASE WHEN y.kept_by = a THEN 'merged' ELSE 'kept' END AS action, la || '-' || lb AS rationale
FROM near JOIN st x ON x.id = a AND x.kept_by = a JOIN st y ON y.id = b AND (y.kept_by = b OR y.kept_by >= a)"""),
    "sentence_split": (sentence_split, r"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS nr, s AS sentence FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]*[.!?\n]|[^.!?\n]+')) AS s, generate_subscripts(regexp_extract_all(text, '[^.!?\n]*[.!?\n]|[^.!?\n]+'), 1) AS i FROM documents) WHERE trim(s) <> ''"),
}
