"""The service around ranking, over logs of calls and jobs: what a call is answered, outboxes, leases, jobs, reports, checks.

Each function has the result that the event-at-a-time service would have after the whole log. Time is a column or a
literal. What depends on a key's last outcome is a walk (`walks`); everything else is column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrade.operators.retrieval import under
from loomgrade.operators.walks import walk
from loomgrade.session import ship

MOST_TEXT = 4_000  # characters of a text that an embedder gets


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def status_rows(calls: DataFrame, *more: str) -> DataFrame:
    """What the rule of `resolve_status` needs of each call, and columns of theirs to keep."""
    key = F.concat_ws("\n", F.sha2(F.coalesce("prompt", F.lit("")), 256), F.concat_ws(",", F.array_sort(F.coalesce("scopes", F.array().cast("array<string>")))))
    first = F.coalesce(F.get("reasons", 0), F.lit("retrieval_degraded"))
    columns = ["session_id", "call_id", micros(F.col("at")).alias("t"), F.coalesce("repo", F.lit("")).alias("repo"), key.alias("key"), "version"]
    flags = [F.coalesce(c, F.lit(False)).alias(n) for c, n in ((F.col("trigger") == "compact", "compact"), (F.col("found") > 0, "found"), (F.col("degraded"), "degraded"), (F.col("clear"), "clear"))]
    return calls.select(*columns, *flags, first.alias("why"), *more)


class StatusRule:
    """What a session's next call is answered; `answered` and `cached` are its memories: get, set and clear by key.

    answered: repository to (version, micros); cached: prompt and scopes to (version, micros, status, reason).
    """

    def __init__(self, answered, cached, suppress_seconds: int | None = None, cache_seconds: int | None = None):
        self.answered, self.cached = answered, cached
        self.limits = [None if s is None else s * 1_000_000 for s in (suppress_seconds, cache_seconds)]

    def __call__(self, t, repo, key, version, compact, found, degraded, clear, why, **_) -> tuple:
        if clear:
            self.answered.clear()
            self.cached.clear()
            return None, None, None
        if not compact:
            for memory, at, most in ((self.answered, repo, self.limits[0]), (self.cached, key, self.limits[1])):
                got = memory.get(at)
                if got and got[0] == version and (most is None or t - got[1] < most):
                    if memory is self.answered:
                        return "duplicate_suppressed", "already_compiled_for_session", "suppression"
                    return got[2], got[3], "cache"
        if degraded:
            return "degraded", why, "retrieval"
        answer = ("ok", None) if found else ("no_match", "no_relevant_skills")
        self.answered[repo] = (version, t)
        self.cached[key] = (version, t, *answer)
        return *answer, "retrieval"


def resolve_status(calls: DataFrame, suppress_seconds: int | None = None, cache_seconds: int | None = None) -> DataFrame:
    """call_id, status, reason, source of every call: suppressed, else cached, else retrieved.

    calls: session_id, call_id, at, repo, prompt, scopes (array), version, trigger, found, degraded, reasons (array), clear.
    A session and repository that was answered at this version is suppressed; a prompt that was answered at this version
    for the same scopes, in any order, comes from the cache. A call of trigger `compact` passes both by, but leaves its
    own answer in them. Degraded answers leave nothing. A row with `clear` empties both for its session, and has no
    status. The seconds limit how long they remember; None is for ever. A session's calls are walked in order.
    """
    rows = status_rows(calls)
    done = walk(rows, "session_id", ["t", "call_id"], lambda: StatusRule({}, {}, suppress_seconds, cache_seconds), "status string, reason string, source string")
    return done.where("NOT clear").select("session_id", "call_id", "status", "reason", "source")


def scopes_considered(resolved: Column, degraded: Column, configured: Column) -> Column:
    """Resolved or degraded scopes in fixed order; the configured ones if there are none."""
    some = F.filter(F.array(F.lit("project"), F.lit("global")), lambda s: F.array_contains(F.coalesce(resolved, F.array().cast("array<string>")), s) | F.array_contains(F.coalesce(degraded, F.array().cast("array<string>")), s))
    return F.when(F.size(some) > 0, some).otherwise(configured)


def degraded_outcome(reasons: Column, degraded: Column, considered: Column) -> Column:
    """reason (the first), reasons and degraded scopes, each once in order; without degraded scopes all considered ones are."""
    why, where = F.array_distinct(reasons), F.array_distinct(degraded)
    return F.struct(F.coalesce(F.get(why, 0), F.lit("retrieval_degraded")).alias("reason"), why.alias("reasons"), F.when(F.size(where) > 0, where).otherwise(considered).alias("degraded"))


def usage_records(answers: DataFrame) -> DataFrame:
    """A row for each ranked skill of an answer whose id is a UUID: session_id, prompt_hash, scope, status, skill_id, relevance.

    answers: session_id, prompt, repo, status, skills (array of skill_id, score).
    """
    uuid = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    scope = F.when(F.coalesce("repo", F.lit("")) == "", "global").otherwise("project")
    hash_ = F.substring(F.sha2(F.coalesce("prompt", F.lit("")), 256), 1, 16)
    rows = answers.select("session_id", hash_.alias("prompt_hash"), scope.alias("scope"), "status", F.explode("skills").alias("s"))
    return rows.where(F.col("s.skill_id").rlike(uuid)).select("session_id", "prompt_hash", "scope", "status", "s.skill_id", F.col("s.score").alias("relevance"))


def append_outbox(stored: DataFrame, incoming: DataFrame, strict: bool = False) -> DataFrame:
    """incoming with outcome: appended, duplicate (conflict if strict), or what is wrong with it.

    stored: idempotency_key; incoming: seq, event_type, idempotency_key, any others. The first of a key is appended.
    """
    reason = F.when(blank(F.col("event_type")), "blank_event_type").when(blank(F.col("idempotency_key")), "blank_idempotency_key")
    rows = incoming.withColumn("__why", reason)
    first = rows.where("__why IS NULL").groupBy("idempotency_key").agg(F.min("seq").alias("__first"))
    first = first.join(stored.select("idempotency_key").distinct(), "idempotency_key", "left_anti")
    again = F.lit("conflict" if strict else "duplicate")
    rows = rows.join(first, "idempotency_key", "left")
    outcome = F.coalesce("__why", F.when(F.col("seq") == F.col("__first"), "appended").otherwise(again))
    return rows.withColumn("outcome", outcome).drop("__why", "__first")


MOVES = {"claim": ("pending", "processing"), "publish": ("processing", "published"), "fail": ("processing", "failed")}


def transition(rows: DataFrame, action: str) -> DataFrame:
    """rows (status) after the action, with error: an illegal move leaves the status and names it."""
    source, target = MOVES[action]
    legal = F.coalesce(F.col("status") == source, F.lit(False))
    error = F.concat(F.lit(f"cannot {action}: status is "), F.coalesce("status", F.lit("null")))
    return rows.withColumns({"error": F.when(~legal, error), "status": F.when(legal, target).otherwise(F.col("status"))})


def correlated(asked: DataFrame, events: DataFrame) -> DataFrame:
    """asked (correlation_id) with exists: whether an event of that correlation is there."""
    own = events.select("correlation_id").where("correlation_id IS NOT NULL").distinct().withColumn("__e", F.lit(True))
    return asked.join(own, "correlation_id", "left").withColumn("exists", F.coalesce("__e", F.lit(False))).drop("__e")


def version_replay(durable: DataFrame, published: DataFrame) -> DataFrame:
    """One row, the version to publish again, if the durable one is beyond the last published; both: version."""
    last = published.agg(F.coalesce(F.max("version"), F.lit(0)).alias("last"))
    now = durable.agg(F.max("version").alias("version"))
    return now.join(F.broadcast(last), F.col("version") > F.col("last")).select("version")  # a row each


def change_recovery(changes: DataFrame, window: int = 64) -> DataFrame:
    """changes (generation, key, path) that are not repeats: a key is one if it came in the last `window` generations, or before in its own."""
    before = F.lag("generation").over(Window.partitionBy("key").orderBy("generation", "path"))
    return changes.withColumn("__b", before).where(F.col("__b").isNull() | (F.col("generation") - F.col("__b") > window)).drop("__b")


def leases(requests: DataFrame) -> DataFrame:
    """requests (name, request_id, owner, at, action, seconds) with granted: acquire, renew or release of a lease by name.

    Free and expired leases, and those of the owner, can be acquired; only the living owner's can be renewed or released.
    """
    rows = requests.select("name", "request_id", "owner", micros(F.col("at")).alias("t"), "action", "seconds")

    def rule():
        held = None  # owner, until

        def step(owner, t, action, seconds, **_):
            nonlocal held
            mine = held is not None and held[0] == owner and t < held[1]
            free = held is None or t >= held[1]
            granted = mine or (action == "acquire" and free)
            if granted:
                held = None if action == "release" else (owner, t + seconds * 1_000_000)
            return (granted,)

        return step

    return walk(rows, "name", ["t", "request_id"], rule, "granted boolean").select("name", "request_id", "granted")


def job_queue(jobs: DataFrame, now: int) -> DataFrame:
    """queue, job_id, position, started, finished, status at `now` of jobs run one after the other, in order of request.

    jobs: queue, job_id, requested, seconds, ok. A job begins when it is asked for and the one before has ended: the end
    is the greatest, over all jobs up to it, of a request and the work from there on, which is a running maximum.
    """
    order = Window.partitionBy("queue").orderBy("requested", "job_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = jobs.withColumn("position", F.row_number().over(order)).withColumn("__s", F.sum("seconds").over(upto))
    rows = rows.withColumn("finished", F.col("__s") + F.max(F.col("requested") - F.col("__s") + F.col("seconds")).over(upto))
    rows = rows.withColumn("started", F.col("finished") - F.col("seconds"))
    ended = F.when(F.col("ok"), "succeeded").otherwise("failed")
    status = F.when(F.col("requested") > now, None).when(F.col("started") > now, "queued").when(F.col("finished") > now, "running").otherwise(ended)
    return rows.select("queue", "job_id", "position", "started", "finished", status.alias("status"))


def cron_ticks(ticks: DataFrame, seconds: int) -> DataFrame:
    """ticks (job, tick_id, t) with outcome: run if the interval since the last run has passed, wait, or error if the clock is before that run."""

    def rule():
        last = None

        def step(t, **_):
            nonlocal last
            if last is not None and t < last:
                return ("error",)
            if last is None or t - last >= seconds:
                last = t
                return ("run",)
            return ("wait",)

        return step

    return walk(ticks.select("job", "tick_id", "t"), "job", ["tick_id"], rule, "outcome string").select("job", "tick_id", "outcome")


def lifecycle(jobs: DataFrame, most_seconds: int) -> DataFrame:
    """job_id, seq, event, at: requested, and completed, failed or timed_out, of jobs (job_id, requested, seconds, ok)."""
    late = F.col("seconds") > most_seconds
    end = F.when(late, "timed_out").when(F.col("ok"), "completed").otherwise("failed")
    at = F.col("requested") + F.least(F.col("seconds"), F.lit(most_seconds))
    both = F.array(F.struct(F.lit("requested").alias("event"), F.col("requested").alias("at")), F.struct(end.alias("event"), at.alias("at")))
    return jobs.select("job_id", F.posexplode(both).alias("seq", "e")).select("job_id", "seq", "e.event", "e.at")


def report(rows: DataFrame, by: list[str], status: str, kinds: tuple[str, ...]) -> DataFrame:
    """by, total and a count of each kind of status."""
    counts = [F.count_if(F.col(status) == k).alias(k) for k in kinds]
    return rows.groupBy(*by).agg(F.count("*").alias("total"), *counts)


def transcript_limits(entries: DataFrame, most_entries: int, most_chars: int, most_total: int) -> DataFrame:
    """session_id, violation: the first limit that a session's entries break, null if none.

    entries: session_id, position (null for a session without entries), content.
    """
    w = Window.partitionBy("session_id").orderBy("position")
    chars = F.coalesce(F.length("content"), F.lit(0))
    rows = entries.withColumns({"i": F.row_number().over(w) - 1, "n": chars}).withColumn("total", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    long = F.concat(F.lit("transcript entry "), F.col("i").cast("string"), F.lit(f" exceeds maximum content size {most_chars}"))
    wrong = F.when(F.col("n") > most_chars, long).when(F.col("total") > most_total, f"transcript total content size exceeds maximum {most_total}")
    found = rows.groupBy("session_id").agg(F.count("position").alias("n"), F.min(F.when(wrong.isNotNull(), F.struct("i", wrong.alias("v")))).alias("w"))
    many = F.concat(F.lit("transcript entry count "), F.col("n").cast("string"), F.lit(f" exceeds maximum {most_entries}"))
    return found.select("session_id", F.when(F.col("n") == 0, "transcript must include at least one entry").when(F.col("n") > most_entries, many).otherwise(F.col("w.v")).alias("violation"))


def reference_error(ref: Column, inline: Column, most_bytes: int = 10 * 1024 * 1024) -> Column:
    """Why a transcript cannot be loaded, null if it can: an inline text is bounded, else a path stays below the root."""
    path = F.trim(F.coalesce(ref, F.lit("")))
    return (
        F.when(inline.isNotNull(), F.when(F.octet_length(inline) > most_bytes, "inline transcript is too large"))
        .when(path == "", "transcript_ref must not be blank")
        .when(F.startswith(path, F.lit("/")), "absolute transcript paths are not allowed")
        .when(F.array_contains(F.split(path, "/"), ".."), "path traversal is not allowed for transcript_ref")
        .when(F.endswith(path, F.lit("/")), "transcript_ref must point to a file")
    )


def may_write(path: Column, roots: Column) -> Column:
    """Whether a path lies under an allowed root; without roots nothing does, nor does a path that climbs."""
    return (F.size(roots) > 0) & path.isNotNull() & ~F.array_contains(F.split(path, "/"), "..") & under(F.array(path), roots)


def active(skills: DataFrame) -> DataFrame:
    return skills.where("lifecycle = 'active'")


def identifier(c: Column) -> Column:
    """A trimmed identifier; null if it is blank or has white space within."""
    own = F.trim(c)
    return F.when((own != "") & ~own.rlike(r"\s"), own)


def touched(rows: DataFrame, changed: Column, now: str) -> DataFrame:
    """rows with updated_at set to now where they changed."""
    return rows.withColumn("updated_at", F.when(changed, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at")))


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 64, most_chars: int = MOST_TEXT) -> DataFrame:
    """rows (text, any others) with vec from a caller's model, `batch` texts at a time in order; a blank text is an error.

    The model gets at most `most_chars` characters of a text, as such models have a limit, and must return a vector each.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list = []
            texts = [t if isinstance(t, str) else "" for t in frame["text"]]
            for a in range(0, len(texts), batch):
                own = [t[:most_chars] for t in texts[a : a + batch]]
                if any(not t.strip() for t in own):
                    raise ValueError("a text to embed is blank")
                made = embedder(own)
                if len(made) != len(own):
                    raise ValueError(f"{len(own)} texts, {len(made)} vectors")
                out += [list(map(float, v)) for v in made]
            yield frame.assign(vec=out)

    ship(rows.sparkSession)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{ddl}, vec array<double>")


def extract(windows: DataFrame, extractor: Callable[[str], list[dict]], fields: str, tries: int = 3, least_chars: int = 100) -> DataFrame:
    """windows (session_id, window, text) with what a caller's model finds in them, a row for each.

    The model maps a text to dicts of `fields` (DDL). An empty or failed answer to a text of `least_chars` or more is
    asked for again, `tries` times in all; shorter texts are asked about once. What still fails gives no rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for session, window, text in zip(frame["session_id"], frame["window"], frame["text"], strict=True):
                found: list[dict] = []
                for _ in range(tries if len(text or "") >= least_chars else 1):
                    try:
                        found = extractor(text or "")
                    except ValueError:
                        found = []
                    if found:
                        break
                rows += [{"session_id": session, "window": window, "nr": i, **f} for i, f in enumerate(found)]
            yield pd.DataFrame(rows, columns=["session_id", "window", "nr", *names])

    names = [f.split()[0] for f in fields.split(", ")]
    ship(windows.sparkSession)
    return windows.select("session_id", "window", "text").mapInPandas(run, f"session_id bigint, window bigint, nr bigint, {fields}")


def with_fallback(subunits: Column, fallback: Column, least: int = 2) -> Column:
    """Structural sub-units, and the fallback's after them if they are too few."""
    own = F.coalesce(subunits, F.array().cast("array<string>"))
    return F.when(F.size(own) < least, F.concat(own, F.coalesce(fallback, F.array().cast("array<string>")))).otherwise(own)


def skeleton_candidates(steps: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """by, name, description, procedures: a window's steps in order under a label's name; labels (by, name, description, keep) may refuse."""
    own = steps.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "command"))), lambda s: s["command"]).alias("procedures"))
    return own.join(labels.where("keep"), by).select(*by, "name", "description", "procedures")


def episode_events(episodes: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """The events that episodes (by, episode, indices) name by position, in the order named; missing ones are skipped."""
    named = episodes.select(*by, "episode", F.posexplode("indices").alias("nr", "position"))
    return named.join(events, [*by, "position"])


def ordered_distinct(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """by and the distinct values, each at its first place; nulls are left out."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min(order).alias("__o"))
    kept = first.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__o", value))).alias("__v"))
    return kept.select(*by, F.transform("__v", lambda x: x[value]).alias("values"))


def sanitized_lines(entries: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, text: `speaker: content` lines of entries that `transcripts.sanitize` has let through."""
    line = F.concat("speaker", F.lit(": "), "content")
    rows = entries.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, line.alias("line")))).alias("l"))
    return rows.select(*by, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def normalised(answers: DataFrame, originals: DataFrame, by: list[str], most_bytes: int = 30) -> DataFrame:
    """by, nr, statement, generality: a model's statements without blanks; generality is that of the first original which has its beginning.

    answers: by, nr, statement; originals: by, nr, statement, generality. The beginning is the characters that fit into `most_bytes`
    bytes, blanks included; A-Z count as a-z. Without such an original it is uncertain.
    """
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    s = F.col("__s")
    fits = F.filter(F.sequence(F.lit(0), F.lit(most_bytes)), lambda n: F.octet_length(F.left(s, n)) <= most_bytes)
    rows = answers.where(~blank(F.col("statement"))).select(*by, "nr", F.col("statement").alias("__s"))
    rows = rows.withColumn("__b", lower(F.left(s, F.array_max(fits))))
    kept = originals.select(*by, F.struct(F.col("nr").alias("o"), F.col("generality").alias("g")).alias("__orig"), lower(F.col("statement")).alias("__t"))
    pairs = rows.join(kept, by, "left")
    found = pairs.groupBy(*by, "nr", "__s").agg(F.min(F.when(F.contains(F.col("__t"), F.col("__b")), F.col("__orig"))).alias("__m"))
    return found.select(*by, "nr", F.trim("__s").alias("statement"), F.coalesce("__m.g", F.lit("uncertain")).alias("generality"))


def preamble_text(repo: Column, language: Column, paths: Column, conventions: Column, preferences: Column) -> Column:
    """The block of a project's facts and the user's standing preferences; parts without content are left out."""
    line = lambda title, c: F.when(c.isNotNull(), F.array(F.concat(F.lit(title), c))).otherwise(F.array().cast("array<string>"))
    named = F.when(F.size(paths) > 0, F.array_join(paths, ", "))
    facts = F.concat(line("Repo: ", repo), line("Language: ", language), line("Key paths: ", named), F.transform(conventions, lambda c: F.concat(F.lit("Convention: "), c)))
    wanted = F.transform(preferences, lambda p: F.concat(F.lit("- "), F.trim(p)))
    section = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.lit(title + "\n"), F.array_join(lines, "\n")))
    return F.concat_ws("\n\n", section("[Project facts]", facts), section("[Standing user preferences]", wanted))


def capped_preamble(repo: Column, language: Column, paths: Column, conventions: Column, preferences: Column, most_tokens: int = 512) -> Column:
    """text, tokens, paths, conventions and preferences of a preamble that fits the tokens, of four bytes each, rounded up.

    Until it fits, the last path is dropped, then the last convention, then the last preference. If nothing of these is left and it still does
    not fit, the text is empty. Each drop is tried by its whole text, so the lists are meant to be short, as mined ones are.
    """
    none = F.array().cast("array<string>")
    p, c, f = (F.coalesce(x, none) for x in (paths, conventions, preferences))
    first = lambda a, n: F.slice(a, F.lit(1), F.greatest(n, F.lit(0)))

    def cut(drop: Column) -> tuple[Column, Column, Column]:
        more = F.greatest(drop - F.size(p), F.lit(0))
        return first(p, F.size(p) - drop), first(c, F.size(c) - more), first(f, F.size(f) - F.greatest(more - F.size(c), F.lit(0)))

    size = lambda drop: F.ceil(F.octet_length(preamble_text(repo, language, *cut(drop))) / 4)
    drops = F.sequence(F.lit(0), F.size(p) + F.size(c) + F.size(f))
    least = F.array_min(F.filter(drops, lambda d: size(d) <= most_tokens))
    kept = cut(F.coalesce(least, F.size(p) + F.size(c) + F.size(f)))
    text = F.when(least.isNotNull(), preamble_text(repo, language, *kept)).otherwise("")
    return F.struct(text.alias("text"), F.ceil(F.octet_length(text) / 4).alias("tokens"), kept[0].alias("paths"), kept[1].alias("conventions"), kept[2].alias("preferences"))


def contract_view(result: Column) -> Column:
    """A result as JSON with its fields in order, for comparison between providers."""
    return F.to_json(result, {"ignoreNullFields": "false"})
