"""Hybrid ranking: cosine, evidence of sub-sections, weighted score, floor, diversity, weighted rank fusion.

Scores are rounded to six or eight places before they are ranked and ties go to the smaller id, so an order never depends on how
rows are dealt. Queries are a stated set: they are broadcast in blocks of a checked size against all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomgrade.functions import text as X
from loomgrade.functions import vectors as V
from loomgrade.session import materialise, ship


@dataclass(frozen=True)
class Config:
    """Tunables of ranking with their defaults; each call may set its own."""

    alpha: float = 0.45
    beta: float = 0.35
    gamma: float = 0.20
    boost: float = 0.25
    candidates: int = 50
    subunits: int = 3
    floor: float = 0.48
    results: int = 3
    diversity: float = 0.65
    rrf_k: float = 60.0
    project_weight: float = 1.0
    global_weight: float = 0.7
    rescue: float = 0.15
    prior_cap: float = 0.15
    prior_days: float = 30.0
    boost_mode: str = "off"

    def __post_init__(self):
        if self.candidates < 1 or self.results < 1 or self.subunits < 1:
            raise ValueError("limits are positive")
        if self.boost_mode not in ("off", "binary", "centroid"):
            raise ValueError(f"no such boost mode: {self.boost_mode}")


DEFAULTS = Config()

#: Names of the tunables. Settings that exist must go on working.
TUNABLES = {
    "RETRIEVAL_CANDIDATE_LIMIT": "candidates",
    "RETRIEVAL_MAX_RESULTS": "results",
    "RETRIEVAL_MAX_SUBUNITS_PER_SKILL": "subunits",
    "RETRIEVAL_RESCUE_THRESHOLD": "rescue",
    "RETRIEVAL_RELEVANCE_THRESHOLD": "floor",
    "RETRIEVAL_MMR_LAMBDA": "diversity",
    "RETRIEVAL_ALPHA": "alpha",
    "RETRIEVAL_BETA": "beta",
    "RETRIEVAL_GAMMA": "gamma",
    "RETRIEVAL_LAMBDA": "boost",
    "RETRIEVAL_PROJECT_SCOPE_WEIGHT": "project_weight",
    "RETRIEVAL_GLOBAL_SCOPE_WEIGHT": "global_weight",
    "RETRIEVAL_RRF_K": "rrf_k",
    "RETRIEVAL_COMMUNITY_BOOST_MODE": "boost_mode",
}
MODES = {"binary": "binary", "centroid_affinity": "centroid", "centroid": "centroid", "affinity": "centroid", "off": "off", "none": "off", "disabled": "off"}


def configured(values: Mapping[str, str], defaults: Config = DEFAULTS) -> Config:
    """The configuration that named values give, such as an environment's. A blank value is the default; a wrong one is an error."""
    changed = {}
    for name, field in TUNABLES.items():
        raw = values.get(name, "").strip()
        if not raw:
            continue
        try:
            changed[field] = MODES[raw.lower()] if field == "boost_mode" else type(getattr(defaults, field))(raw)
        except (KeyError, ValueError):
            raise ValueError(f"{name} is set but not a valid value: {raw!r}") from None
    return replace(defaults, **changed)


BLOCK = 10_000  # queries that are broadcast together
QUERY_BYTES = 64 << 20  # of their vectors or words
STEP = 64  # queries that meet a batch of rows together


def in_blocks(queries: DataFrame, against: Callable[[DataFrame], DataFrame], key: str = "query_id", block: int = BLOCK, weight: Column | None = None, most_bytes: int = QUERY_BYTES) -> DataFrame:
    """`against` applied to the broadcast queries, `block` of them at a time, and of at most `most_bytes` by `weight`."""
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(weight if weight is not None else F.lit(0)), F.lit(0))).first()
    blocks = max(1, -(-n // block), -(-int(size) // most_bytes))
    if blocks == 1:
        return against(F.broadcast(queries))
    out = None
    for b in range(blocks):
        part = against(F.broadcast(queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)))
        out = part if out is None else out.unionByName(part)
    return out


def of_words(words: str) -> Column:
    """About the bytes of a row with that array of words."""
    return 32 * F.size(words) + 1_000


def six(c: Column) -> Column:
    return F.round(c, 6)


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1; the filter on the row number prunes before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def under(paths: Column, roots: Column) -> Column:
    """Every path lies under some root, by whole components; without roots anything does, without paths nothing does."""
    inside = F.forall(paths, lambda p: F.exists(roots, lambda r: (p == r) | F.startswith(p, F.concat(r, F.lit("/")))))
    return (F.size(roots) == 0) | ((F.size(paths) > 0) & inside)


def _unit(vectors: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: which vectors have it, and they themselves at length one. Null, empty, zero and non-finite ones are in none."""
    v = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(v.offsets.to_numpy())
    sizes = np.where(v.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    out = {}
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        x = v.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, d)
        norm = np.sqrt((x * x).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        out[d] = at[good], x[good] / norm[good][:, None]
    return out


class _Best:
    """The k highest scores of each query and group seen so far; ties go to the smaller id."""

    def __init__(self, k: int):
        self.k, self.held, self.size, self.room = k, [], 0, 1 << 16

    def add(self, query: np.ndarray, group: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        self.held.append((query, group, row, score))
        self.size += len(query)
        if self.size > self.room:
            self.held = [self.all()]
            self.size = len(self.held[0][0])
            self.room = max(self.room, 2 * self.size)

    def all(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        query, group, row, score = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((row, -score, group, query))
        query, group, row, score = query[order], group[order], row[order], score[order]
        first = np.r_[True, (query[1:] != query[:-1]) | (group[1:] != group[:-1])]
        place = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
        keep = place < self.k
        return query[keep], group[keep], row[keep], score[keep]


def _blocks(queries: DataFrame, most_bytes: int) -> list[DataFrame]:
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(8 * F.coalesce(F.size("qvec"), F.lit(0)) + 16), F.lit(0))).first()
    blocks = max(1, -(-int(size) // most_bytes), -(-n // BLOCK))
    return [queries] if blocks == 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)]


def cosine_topk(queries: DataFrame, rows: DataFrame, k: int | None, by: tuple[str, ...] = ("query_id",), most_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, (the group,) skill_id, cosine, rank: the k rows most like each query, or those of each group; all of them if k is None.

    queries: query_id (bigint), qvec; rows: skill_id (bigint), vec, and the group that `by` names beside query_id. Queries are a broadcast
    matrix, a block of at most `most_bytes` and BLOCK queries at a time; a batch of rows meets it in a matrix product, and a task keeps k rows a
    query and group. Nothing but those is shuffled. Cosines are rounded to six places and not below 0; vectors of another length, of norm zero, null or with
    values that are not finite are like nothing, 0. Ties go to the smaller skill_id.
    """
    spark = rows.sparkSession
    ship(spark)
    group = by[1] if len(by) > 1 else None
    kind = rows.schema[group].dataType.simpleString() if group else "string"
    slim = rows.select("skill_id", "vec", F.col(group).alias("g") if group else F.lit(None).cast("string").alias("g"))
    group_type = to_arrow_type(slim.schema["g"].dataType)
    out = None
    for block in _blocks(queries.select("query_id", "qvec"), most_bytes):
        own = block.toArrow()
        asked = spark.sparkContext.broadcast((own.column("query_id").to_numpy(), _unit(own.column("qvec"))))

        def meet(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            ids, matrices = asked.value
            best, groups = _Best(k or 0), {}

            def table(query, g, row, score):
                names = list(groups)
                return pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array([names[i] for i in g.tolist()], group_type), pa.array(row), pa.array(score / 1e6)], names=["query_id", "g", "skill_id", "cosine"])

            for batch in batches:
                batch = batch.sort_by("skill_id")
                rows_, g = batch.column("skill_id").to_numpy(), np.array([groups.setdefault(x, len(groups)) for x in batch.column("g").to_pylist()], np.int64)
                units = _unit(batch.column("vec"))
                for start in range(0, len(ids), STEP):
                    like = np.zeros((min(STEP, len(ids) - start), len(rows_)))
                    for d, (q, x) in matrices.items():
                        inside = np.flatnonzero((q >= start) & (q < start + STEP))
                        if d in units and len(inside):
                            like[np.ix_(q[inside] - start, units[d][0])] = x[inside] @ units[d][1].T
                    score = np.floor(np.maximum(like, 0) * 1e6 + 0.5).astype(np.int64)
                    for c in np.unique(g):
                        at = np.flatnonzero(g == c)
                        # rows are in order of their ids, so an earlier place breaks a tie
                        order = score[:, at] * len(at) + np.arange(len(at))[::-1]
                        if k is not None and k < len(at):
                            top_ = np.argpartition(-order, k - 1, axis=1)[:, :k]
                        else:
                            top_ = np.broadcast_to(np.arange(len(at)), order.shape)
                        q = np.repeat(np.arange(start, start + len(order)), top_.shape[1])
                        r = at[top_.ravel()]
                        found = (q, np.full(len(q), c), rows_[r], score[q - start, r])
                        if k is None:
                            yield table(*found)
                        else:
                            best.add(*found)
            if k is not None:
                query, g, row, score = best.all()
                for a in range(0, len(query), 100_000):
                    yield table(*(c[a : a + 100_000] for c in (query, g, row, score)))

        part = slim.mapInArrow(meet, f"query_id bigint, g {kind}, skill_id bigint, cosine double")
        out = part if out is None else out.unionByName(part)
    out = out.withColumnRenamed("g", group) if group else out.drop("g")
    return out if k is None else top(out, list(by), [F.desc("cosine"), F.col("skill_id")], k)


def subunit_scores(candidates: DataFrame, subunits: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, skill_id, subunit_id, semantic (cosine, not below 0), lexical and blended relevance of candidates' sub-sections to the query.

    candidates: query_id, skill_id, read several times; subunits: skill_id, subunit_id, title, content, svec; queries: query_id, prompt, qvec.
    A sub-section's words and vector move once, to its candidates; queries are broadcast in blocks of bounded bytes, so nothing wide moves with a pair.
    """
    wanted = candidates.select("skill_id").distinct()
    own = subunits.join(wanted, "skill_id", "left_semi").select("skill_id", "subunit_id", "svec", X.words(F.concat_ws(" ", "title", "content")).alias("__cw"))
    asked = queries.select("query_id", "qvec", X.words(F.col("prompt")).alias("__pw"))
    semantic = six(F.greatest(V.cosine(F.col("qvec"), F.col("svec")), F.lit(0.0)))
    lexical = six(X.overlap(F.col("__pw"), F.col("__cw")))

    def score(block: DataFrame) -> DataFrame:
        rows = candidates.select("query_id", "skill_id").join(own, "skill_id").join(block, "query_id")
        return rows.select("query_id", "skill_id", "subunit_id", semantic.alias("semantic"), lexical.alias("lexical"))

    return in_blocks(asked, score, weight=of_words("__pw")).withColumn("relevance", F.round(0.75 * F.col("semantic") + 0.25 * F.col("lexical"), 8))


def evidence(scored: DataFrame, k: int = 3) -> DataFrame:
    """Mean of the k greatest semantic scores of a candidate's sub-sections."""
    best = top(scored, ["query_id", "skill_id"], [F.desc("semantic"), F.col("subunit_id")], k, "at")
    return best.groupBy("query_id", "skill_id").agg(six(F.avg("semantic")).alias("evidence"))


def usage_prior(usage: DataFrame, now: str, config: Config = DEFAULTS) -> DataFrame:
    """skill_id, uses, prior from usage (skill_id, used_at): logarithm of the uses, fading by whole days since the last."""
    age = F.greatest(F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_used")) / 86400), F.lit(0))
    rows = usage.groupBy("skill_id").agg(F.count("*").alias("uses"), F.max("used_at").alias("last_used"))
    return rows.select("skill_id", "uses", six(F.least(F.log1p("uses") * F.exp(-age / config.prior_days), F.lit(config.prior_cap))).alias("prior"))


def weighted_score(rows: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """score from cosine, evidence, prior and community_boost; missing parts count as 0."""
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = (config.alpha * part("cosine") + config.beta * part("evidence") + config.gamma * part("prior")) * (1 + config.boost * part("community_boost"))
    return rows.withColumn("score", F.round(score, 8))


def centroids(rows: DataFrame) -> DataFrame:
    """community_id, centroid: mean of its members' vectors, by place; vectors of another length than the longest are left out."""
    usual = rows.groupBy("community_id").agg(F.max(F.size("vec")).alias("d"))
    places = rows.join(usual, "community_id").where(F.size("vec") == F.col("d")).select("community_id", F.posexplode("vec").alias("at", "x"))
    means = places.groupBy("community_id", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("community_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("centroid"))


def community_boost(found: DataFrame, mode: str, communities: DataFrame | None) -> DataFrame:
    """`found` with community_boost by mode: binary (0.2 for members of a community), centroid (their community's cosine to the query), off.

    found: query_id, skill_id, qvec; communities: skill_id, community_id, vec of members. A skill of several communities
    counts with the least id. Without communities there is no boost.
    """
    if mode == "off" or communities is None:
        return found.withColumn("community_boost", F.lit(0.0))
    own = communities.groupBy("skill_id").agg(F.min("community_id").alias("community_id"))
    if mode == "binary":
        rows = found.join(own, "skill_id", "left")
        return rows.withColumn("community_boost", F.when(F.col("community_id").isNotNull(), 0.2).otherwise(0.0)).drop("community_id")
    centres = centroids(communities.join(own, ["skill_id", "community_id"], "left_semi").select("community_id", "vec"))
    rows = found.join(own, "skill_id", "left").join(centres, "community_id", "left")
    boost = F.least(F.greatest(V.cosine(F.col("qvec"), F.col("centroid")), F.lit(0.0)), F.lit(1.0))
    return rows.withColumn("community_boost", six(F.coalesce(boost, F.lit(0.0)))).drop("community_id", "centroid")


def scored_candidates(
    queries: DataFrame, skills: DataFrame, subunits: DataFrame, usage: DataFrame, now: str, config: Config = DEFAULTS, communities: DataFrame | None = None
) -> DataFrame:
    """Every scope's candidates of each query that reach the floor, with their parts, score and place (`rank`) by score in the scope."""
    # ids and vectors first; the few candidates are written, so that their number is known when texts join them
    found = cosine_topk(queries, skills, config.candidates, ("query_id", "scope")).drop("rank")
    found = materialise(found, "candidates")
    parts = evidence(subunit_scores(found, subunits, queries), config.subunits)
    asked = queries.select("query_id", X.words(F.col("prompt")).alias("__pw"))
    texts = skills.join(found.select("skill_id").distinct(), "skill_id", "left_semi").select("skill_id", X.words(F.col("text")).alias("__tw"))
    lexical = six(X.overlap(F.col("__pw"), F.col("__tw")))
    found = in_blocks(asked, lambda block, found=found: found.join(texts, "skill_id").join(block, "query_id").select(*found.columns, lexical.alias("lexical")), weight=of_words("__pw"))
    if config.boost_mode == "centroid" and communities is not None:
        found = found.join(queries.select("query_id", "qvec"), "query_id")
    found = community_boost(found, config.boost_mode, communities).drop("qvec")
    prior = usage_prior(usage, now, config).drop("uses")
    rows = found.join(parts, ["query_id", "skill_id"], "left").join(prior, "skill_id", "left")
    rows = weighted_score(rows, config)
    rows = rows.fillna(0.0, ["evidence", "prior"]).where(F.col("score") >= config.floor)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "scope").orderBy(F.desc("score"), "skill_id")))


def ranked_candidates(
    queries: DataFrame, skills: DataFrame, subunits: DataFrame, usage: DataFrame, now: str, config: Config = DEFAULTS, communities: DataFrame | None = None
) -> DataFrame:
    """`scored_candidates` in the order of `mmr`, which is what scopes are fused by: `rank` is the place in that order."""
    rows = scored_candidates(queries, skills, subunits, usage, now, config, communities)
    rows = materialise(rows, "scored")  # few rows, read twice below
    chosen = mmr(rows.join(skills.select("skill_id", "vec"), "skill_id"), ["query_id", "scope"], config, config.candidates)
    order = chosen.select("query_id", "scope", "skill_id", "mmr_rank")
    return rows.drop("rank").join(order, ["query_id", "scope", "skill_id"]).withColumnRenamed("mmr_rank", "rank")


def mmr(rows: DataFrame, by: list[str], config: Config = DEFAULTS, k: int | None = None) -> DataFrame:
    """Greedy diversity order of each group: score against the greatest cosine to what is already chosen; ties to the smaller rank.

    rows: the group's columns, skill_id, score, rank, vec. A group is one scope's candidates of one query, `candidates` at most.
    """
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    ddl = ", ".join(f"{c} {fields[c]}" for c in [*by, "skill_id", "score"]) + ", mmr_rank int, mmr_score double"
    lam = min(max(config.diversity, 0.0), 1.0)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        v = np.array(pdf["vec"].tolist(), float)
        n = np.linalg.norm(v, axis=1)
        v = v / np.where(n > 0, n, 1)[:, None]
        score, worst = pdf["score"].to_numpy(), np.zeros(len(pdf))
        left, order, values = list(range(len(pdf))), [], []
        while left and len(order) < (k or len(pdf)):
            value = np.round(lam * score[left] - (1 - lam) * worst[left], 6)
            i = left.pop(int(np.argmax(value)))
            order.append(i)
            values.append(float(value.max()))
            worst = np.maximum(worst, v @ v[i])
        out = pdf.loc[order, [*by, "skill_id", "score"]]
        return out.assign(mmr_rank=range(1, len(order) + 1), mmr_score=values)

    return rows.select(*by, "skill_id", "score", "rank", "vec").groupBy(*by).applyInPandas(choose, ddl)


def fuse(rows: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Weighted reciprocal ranks summed over scopes, with the best row of each skill and the fused order.

    rows: query_id, scope, skill_id, rank, score, cosine, lexical. An odd k counts as 60; scopes without weight are skipped.
    """
    k = config.rrf_k if np.isfinite(config.rrf_k) and config.rrf_k > 0 else 60.0
    weight = F.when(F.col("scope") == "project", config.project_weight).otherwise(config.global_weight)
    priority = F.when(F.col("scope") == "project", 3).when(F.col("scope") == "global", 2).otherwise(1)
    rows = rows.withColumns({"weight": weight, "priority": priority}).where(F.col("weight") > 0)
    best = F.max_by(F.struct("scope", "priority", "score", "cosine", "lexical"), F.struct("score", "priority"))
    fused = rows.groupBy("query_id", "skill_id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 8).alias("rrf"), best.alias("b"))
    fused = fused.select("query_id", "skill_id", "rrf", "b.*")
    order = [F.desc("rrf"), F.desc("priority"), F.desc("cosine"), F.desc("lexical"), F.col("skill_id")]
    return fused.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def score_bucket(score: Column) -> Column:
    return F.when(score >= 0.40, "high").when(score >= 0.20, "medium").otherwise("low")


def match_reason(scope: Column, score: Column, semantic: Column, lexical: Column) -> Column:
    return F.concat(F.lit("scope="), scope, F.lit(" | bucket="), score_bucket(score), F.lit(" | semantic="), X.three_places(semantic), F.lit(" | lexical="), X.three_places(lexical))
