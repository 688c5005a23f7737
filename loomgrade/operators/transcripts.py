"""Session transcripts: typed events from JSON lines, windows, salience, preferences, procedures, candidates.

Events are rows of one wide shape (EVENT), as Spark has no union type. An event's place is its line and its number within
the line, so several events of one line keep their order and stay distinct.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrade.functions import text as X
from loomgrade.functions.fixed import COMMAND_LANGUAGES, EXTENSION_LANGUAGES, PREFERENCE_PHRASES, REFUSED_PREFIXES, REFUSED_SPEAKERS, SALIENCE_PHRASES, SCOPING_PHRASES, SYSTEM_DIRECTORIES

EVENT = "struct<kind:string,content:string,tool_use_id:string,name:string,input_json:string,output:string,is_error:boolean,exit_code:int,path:string,operation:string,malformed:boolean>"
_FIELDS = ["kind", "content", "tool_use_id", "name", "input_json", "output", "is_error", "exit_code", "path", "operation", "malformed"]


def _event(kind: str, **values: Column) -> Column:
    types = dict(is_error="boolean", exit_code="int", malformed="boolean")
    values = {"kind": F.lit(kind), "malformed": F.lit(False)} | values
    return F.struct(*[values.get(f, F.lit(None)).cast(types.get(f, "string")).alias(f) for f in _FIELDS])


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _string(v: Column, path: str) -> Column:
    """The string at a path; null for anything else there."""
    return F.when(F.schema_of_variant(_get(v, path, "variant")) == "STRING", _get(v, path))


def exit_code(output: Column) -> Column:
    return F.regexp_extract(output, r"^Exit code [ \t]*([-+]?\d+)\s*(?:\n|$)", 1).try_cast("int")


def _is_array(v: Column, path: str) -> Column:
    return F.startswith(F.schema_of_variant(_get(v, path, "variant")), F.lit("ARRAY"))


def _content(v: Column, path: str) -> Column:
    """A string, or the texts of an array's parts joined by a space; trimmed, null if that leaves nothing."""
    parts = F.filter(F.transform(_get(v, path, "array<variant>"), lambda p: F.trim(_string(p, "$.text"))), lambda t: t.isNotNull() & (t != ""))
    whole = F.when(_is_array(v, path), F.array_join(parts, " ")).otherwise(F.trim(_string(v, path)))
    return F.when(whole != "", whole)


def parse_events(lines: DataFrame) -> DataFrame:
    """session_id, line, part and the columns of EVENT from session_id, line (from 0), json; nothing fails on a bad line.

    A line that is no JSON becomes a placeholder message and counts as malformed; blank ones vanish.
    """
    own = lines.where(F.trim("json") != "").withColumn("v", F.try_parse_json("json"))
    v, no = F.col("v"), (F.col("line") + 1).cast("string")
    speaker = F.trim(F.coalesce(_string(v, "$.speaker"), _string(v, "$.role"), _string(v, "$.message.role")))
    speaker = F.when(speaker != "", speaker)
    content = F.coalesce(_content(v, "$.content"), _content(v, "$.message.content"))
    said = F.when(speaker == "user", _event("user", content=content)).otherwise(_event("assistant", content=content))
    flat = F.when(speaker.isNotNull() & content.isNotNull(), F.array(said)).otherwise(F.array().cast(f"array<{EVENT}>"))
    none = F.array().cast(f"array<{EVENT}>")
    blocks = _get(v, "$.message.content", "array<variant>")
    shape = F.schema_of_variant(_get(v, "$.message.content", "variant"))

    def result(b: Column) -> Column:
        output = F.coalesce(_string(b, "$.content"), F.lit(""))
        return _event("tool_result", tool_use_id=F.coalesce(_string(b, "$.tool_use_id"), F.lit("")), output=output, is_error=F.coalesce(_get(b, "$.is_error", "boolean"), F.lit(False)), exit_code=exit_code(output))

    def use(b: Column) -> Column:
        name, key = F.coalesce(_string(b, "$.name"), F.lit("unknown")), F.coalesce(_string(b, "$.id"), F.lit(""))
        call = _event("tool_call", tool_use_id=key, name=name, input_json=F.coalesce(F.to_json(_get(b, "$.input", "variant")), F.lit("{}")))
        edit = _event("file_edit", tool_use_id=key, path=F.coalesce(_string(b, "$.input.file_path"), F.lit("")), operation=name)
        return F.when(name.isin("Write", "Edit", "MultiEdit"), F.array(edit, call)).otherwise(F.array(call))

    kind = lambda b: F.coalesce(_string(b, "$.type"), F.lit(""))
    user = (
        F.when(shape == "STRING", F.when(F.trim(_string(v, "$.message.content")) != "", F.array(_event("user", content=F.trim(_string(v, "$.message.content"))))).otherwise(none))
        .when(_is_array(v, "$.message.content"), F.transform(F.filter(blocks, lambda b: kind(b) == "tool_result"), result))
        .when(shape.isNull(), flat)
        .otherwise(F.array(_event("user", content=F.concat(F.lit("[unexpected content shape on line "), no, F.lit("]")), malformed=F.lit(True))))
    )
    spoken = lambda b: F.trim(F.coalesce(_string(b, "$.text"), F.lit("")))
    each = lambda b: F.when((kind(b) == "text") & (spoken(b) != ""), F.array(_event("assistant", content=spoken(b)))).when(kind(b) == "tool_use", use(b)).otherwise(none)
    plain = F.when(content.isNotNull(), F.array(_event("assistant", content=content))).otherwise(none)
    assistant = F.when(_is_array(v, "$.message.content"), F.flatten(F.transform(blocks, each))).otherwise(plain)
    type_ = F.coalesce(_string(v, "$.type"), F.lit("unknown"))
    other = F.when(speaker.isNotNull() & content.isNotNull(), F.array(said)).otherwise(F.array(_event("metadata", content=type_)))
    bad = F.array(_event("user", content=F.concat(F.lit("[unparseable line "), no, F.lit("]")), malformed=F.lit(True)))
    made = F.when(v.isNull(), bad).when(type_ == "user", user).when(type_ == "assistant", assistant).when(type_ == "message", flat).otherwise(other)
    rows = own.select("session_id", "line", made.alias("made")).select("session_id", "line", F.posexplode("made").alias("part", "e"))
    return rows.select("session_id", "line", "part", "e.*")


def conversational(events: DataFrame) -> DataFrame:
    return events.where(F.col("kind").isin("user", "assistant"))


def budget_windows(events: DataFrame, budget: int, overlap: int) -> DataFrame:
    """session_id, window, first, size: positions from 0 of windows whose tokens fit the budget, each of one event at least.

    events: session_id, position, tokens. The next window begins `overlap` events before the last one's end, or one
    further on if it was no longer than that; the window that reaches the end is the last. A session is one group.
    """

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        total = np.concatenate(([0], np.cumsum(pdf["tokens"].to_numpy())))
        n, start, out = len(pdf), 0, []
        while start < n:
            end = max(start + 1, int(np.searchsorted(total, total[start] + budget, side="right")) - 1)
            out.append((start, end - start))
            if end >= n:
                break
            start = start + 1 if end - start <= overlap else end - overlap
        return pd.DataFrame({"session_id": pdf["session_id"].iloc[0], "window": range(len(out)), "first": [a for a, _ in out], "size": [b for _, b in out]})

    return events.select("session_id", "position", "tokens").groupBy("session_id").applyInPandas(cut, "session_id bigint, window bigint, first bigint, size bigint")


def _failed() -> Column:
    return F.col("is_error") | F.coalesce(F.col("exit_code") != 0, F.lit(False))


def salience(events: DataFrame, by: list[str]) -> DataFrame:
    """Flags, score, hard_keep and reason of every window (`by`). events: by, position and the columns of EVENT.

    A result belongs to the last-named tool of its id, or to "unknown"; an arc is resolved if a tool that failed succeeds later.
    """
    calls = events.where("kind = 'tool_call'").groupBy(*by, "tool_use_id").agg(F.max_by("name", "position").alias("tool"))
    rows = events.join(calls, [*by, "tool_use_id"], "left").withColumn("tool", F.coalesce("tool", F.lit("unknown")))
    result = F.col("kind") == "tool_result"
    rows = rows.withColumn("failed", result & _failed())
    before = Window.partitionBy(*by, "tool").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("solved", result & ~F.col("failed") & F.coalesce(F.max("failed").over(before), F.lit(False)))
    stated = (F.col("kind") == "user") & X.contains_any(X.ascii_lower(F.coalesce("content", F.lit(""))), SALIENCE_PHRASES)
    flags = rows.groupBy(*by).agg(
        F.bool_or("solved").alias("resolved_arc"),
        F.bool_or(stated).alias("preference"),
        F.bool_or("failed").alias("failure"),
        F.bool_or(F.col("kind") == "file_edit").alias("file_edit"),
        F.bool_or((F.col("kind") == "tool_call") & (F.col("name") == "Bash")).alias("bash"),
    )
    weights = {"resolved_arc": 0.60, "preference": 0.55, "failure": 0.35, "file_edit": 0.30, "bash": 0.15}
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.when(F.col(c), w).otherwise(0.0)
    reason = F.when(F.col("resolved_arc"), "resolved_error_arc").when(F.col("preference"), "stated_preference")
    return flags.withColumn("score", F.round(F.least(total, F.lit(1.0)), 6)).withColumn("hard_keep", F.col("resolved_arc") | F.col("preference")).withColumn("reason", reason)


def gate_threshold(scores: DataFrame, least: float) -> DataFrame:
    """Windows that stay: those to be kept in any case, and those that score enough."""
    return scores.where(F.col("hard_keep") | (F.col("score") >= least))


def gate_topk(scores: DataFrame, k: int, session: str, order: str) -> DataFrame:
    """The k best of a session's other windows (ties to the earlier), and those to be kept in any case, which do not count."""
    rank = F.row_number().over(Window.partitionBy(session, "hard_keep").orderBy(F.desc("score"), order))
    return scores.withColumn("place", rank).where(F.col("hard_keep") | (F.col("place") <= k)).drop("place")


def preferences(events: DataFrame, by: list[str]) -> DataFrame:
    """by, statement, generality of sentences of user messages with a preference's phrase; each once, by its first place.

    events: by, position, kind, content.
    """
    cut = events.where("kind = 'user'").select(*by, "position", F.posexplode(X.sentences(F.col("content"))).alias("nr", "s"))
    rows = cut.withColumn("s", F.regexp_replace("s", r"^\s+|\s+$", "")).where(F.col("s") != "")
    low = X.ascii_lower(F.col("s"))
    rows = rows.where(X.contains_any(low, PREFERENCE_PHRASES)).withColumn("generality", F.when(X.contains_any(low, SCOPING_PHRASES), "uncertain").otherwise("general"))
    first = F.row_number().over(Window.partitionBy(*by, F.lower("s")).orderBy("position", "nr"))
    return rows.withColumn("r", first).where("r = 1").select(*by, F.col("s").alias("statement"), "generality")


def preference_candidates(rows: DataFrame, by: list[str]) -> DataFrame:
    name = F.concat(F.array_join(F.slice(F.filter(F.split("statement", r"\s+"), lambda w: w != ""), 1, 8), " "), F.lit(" (preference)"))
    return rows.select(*by, name.alias("name"), F.col("statement").alias("description"), F.lit(0.7).alias("confidence"), "generality")


def plurality(votes: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The value of most votes; of equal ones the one first seen last."""
    counts = votes.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("n", "seen")).alias(value), F.max("n").alias("votes"))


def salient_paths(events: DataFrame, by: list[str], most: int = 10) -> DataFrame:
    """by, paths: the first of the sorted distinct paths of edits."""
    rows = events.where("kind = 'file_edit' AND path <> ''").groupBy(*by).agg(F.sort_array(F.collect_set("path")).alias("p"))
    return rows.select(*by, F.slice("p", 1, most).alias("paths"))


def _project_parts(parts: Column) -> Column:
    """A path's components without system folders and the one behind each, which is a user's or a mount's."""
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("kept"))
    system = lambda x: x.isin(*SYSTEM_DIRECTORIES)
    step = lambda s, x: F.struct((~s["skip"] & system(x)).alias("skip"), F.when(s["skip"] | system(x), s["kept"]).otherwise(F.concat(s["kept"], F.array(x))).alias("kept"))
    return F.aggregate(parts, start, step, lambda s: s["kept"])


def salient_path(path: Column) -> Column:
    """Two components below a path's project, or what it has; null for none."""
    kept = _project_parts(F.filter(F.split(F.trim(path), "/"), lambda x: x != ""))
    two = F.when(F.size(kept) >= 3, F.slice(kept, 2, 2)).otherwise(kept)
    return F.when(F.size(kept) > 0, F.array_join(two, "/"))


def repository_name(path: Column) -> Column:
    """The first component of a path that is no system folder, not behind one, and longer than a byte."""
    kept = _project_parts(F.split(F.regexp_replace(path, "^/+", ""), "/"))
    return F.get(F.filter(kept, lambda x: F.octet_length(x) > 1), 0)


def _language(value: Column, known: dict[str, tuple[str, ...]], test) -> Column:
    out = F.lit(None).cast("string")
    for name, marks in reversed(known.items()):
        out = F.when(F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: test(value, m)), F.lit(name)).otherwise(out)
    return out


def project_facts(events: DataFrame, by: list[str], most: int = 10) -> DataFrame:
    """by, repo_name, primary_language, paths of a session's events (by, position and the columns of EVENT).

    A Bash call's command and an edited file's ending vote for a language; the most votes win, of equal ones the language first
    seen last. The repository is that of the first edited path that tells one; paths are the first of the sorted salient ones.
    """
    lower_ascii = F.translate(F.get_json_object("input_json", "$.command"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    edit = F.col("kind") == "file_edit"
    command = F.when((F.col("kind") == "tool_call") & (F.col("name") == "Bash"), _language(lower_ascii, COMMAND_LANGUAGES, F.contains))
    rows = events.select(*by, "position", "kind", F.when(edit, F.col("path")).alias("edited"), F.when(edit, _language(F.col("path"), EXTENSION_LANGUAGES, F.endswith)).otherwise(command).alias("primary_language"))
    votes = plurality(rows.where("primary_language IS NOT NULL"), by, "primary_language", "position").drop("votes")
    edits = rows.where("edited IS NOT NULL").select(*by, "position", repository_name(F.col("edited")).alias("repo"), salient_path(F.col("edited")).alias("path"))
    first = F.min(F.when(F.col("repo").isNotNull(), F.struct("position", "repo")))
    told = edits.groupBy(*by).agg(first.alias("r"), F.slice(F.sort_array(F.collect_set("path")), 1, most).alias("paths"))
    whole = rows.select(*by).distinct().join(votes, by, "left").join(told, by, "left")
    return whole.select(*by, F.col("r.repo").alias("repo_name"), "primary_language", F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))


def command_text(name: Column, input_json: Column) -> Column:
    """A Bash call's command; another tool's name with its first two inputs; the first 60 characters of what is no object."""
    fields = F.from_json(input_json, "map<string,string>")
    keys = F.slice(F.array_sort(F.map_keys(fields)), 1, 2)
    args = F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("="), F.coalesce(F.element_at(fields, k), F.lit("")))), ", ")
    other = F.when(fields.isNull(), F.concat(name, F.lit("("), F.substring(input_json, 1, 60), F.lit(")"))).otherwise(F.concat(name, F.lit("("), args, F.lit(")")))
    return F.when(name == "Bash", F.coalesce(F.get_json_object(input_json, "$.command"), name)).otherwise(other)


def skeleton_steps(events: DataFrame, by: list[str]) -> DataFrame:
    """by, step, tool_use_id, tool, command: edits and calls between a window's first failure and its last lasting success.

    events: by, position and the columns of EVENT. Without such a success the arc runs to the end. Of events of one id an
    edit stands for the call.
    """
    result = F.col("kind") == "tool_result"
    first = F.min(F.when(result & _failed(), F.col("position"))).over(Window.partitionBy(*by))
    rows = events.withColumn("trigger", first).where("position > trigger")
    bad = F.max(F.when(result & _failed(), F.col("position"))).over(Window.partitionBy(*by))
    good = F.max(F.when(result & ~_failed(), F.col("position"))).over(Window.partitionBy(*by))
    rows = rows.withColumns({"bad": bad, "good": good})
    rows = rows.where(F.col("good").isNull() | (F.coalesce("bad", F.lit(-1)) > F.col("good")) | (F.col("position") <= F.col("good")))
    steps = rows.where(F.col("kind").isin("file_edit", "tool_call"))
    rank = F.row_number().over(Window.partitionBy(*by, "tool_use_id").orderBy(F.col("kind") != "file_edit", "position"))
    steps = steps.withColumn("r", rank).where("r = 1")
    edit = F.col("kind") == "file_edit"
    command = F.when(edit, F.concat_ws(" ", "operation", "path")).otherwise(command_text(F.col("name"), F.col("input_json")))
    step = F.row_number().over(Window.partitionBy(*by).orderBy("position"))
    return steps.select(*by, step.alias("step"), "tool_use_id", F.when(edit, F.col("operation")).otherwise(F.col("name")).alias("tool"), command.alias("command"))


def contract_violations(candidates: DataFrame, least: float = 0.5, most_description: int = 256, most_name: int = 64) -> DataFrame:
    """candidates (name, description, confidence, procedures, conventions) with violations, an array of what is wrong."""
    name, description = F.coalesce("name", F.lit("")), F.coalesce("description", F.lit(""))
    rules = [
        (name == "", "missing name"),
        (description == "", "missing description"),
        (F.octet_length(description) > most_description, "description exceeds max length"),
        (F.coalesce("confidence", F.lit(0.0)) < least, "confidence below minimum threshold"),
        ((F.coalesce(F.size("procedures"), F.lit(0)) <= 0) & (F.coalesce(F.size("conventions"), F.lit(0)) <= 0), "no procedures or conventions (non-actionable)"),
        (F.octet_length(name) > most_name, "name exceeds 64 chars"),
        (~name.rlike("^[a-z0-9-]*$"), "name is not valid kebab-case"),
    ]
    return candidates.withColumn("violations", F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in rules]), lambda x: x.isNotNull()))


def sanitize(entries: DataFrame) -> DataFrame:
    """entries (speaker, content) that may enter a prompt, their content without control and non-ASCII characters."""
    clean = F.regexp_replace(F.coalesce("content", F.lit("")), r"[^\x21-\x7E \n]", "")
    rows = entries.where(~X.contains_any(F.coalesce("speaker", F.lit("")), REFUSED_SPEAKERS)).withColumn("content", clean)
    refused = F.lit(False)
    for p in REFUSED_PREFIXES:
        refused = refused | F.startswith("content", F.lit(p))
    return rows.where((F.trim("content") != "") & ~refused)


def dedup_subunits(rows: DataFrame, by: list[str]) -> DataFrame:
    """The first of each kind, title and content, without case and outer blanks. rows: by, position, kind, title, content."""
    key = F.lower(F.trim(F.concat_ws(":", "kind", "title", "content")))
    first = F.row_number().over(Window.partitionBy(*by, F.xxhash64(key), key).orderBy("position"))
    return rows.withColumn("r", first).where("r = 1").drop("r")
