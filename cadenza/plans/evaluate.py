"""Offline evaluation: E17 evaluate_model, E18 compare_models, the flagship.

A model is a ``Recommender`` (see ``plans.contract``): any pair of functions that
trains and that makes lists.  Built in are ALS factors (M1) with three ways of
turning them into lists, ``als`` (M4, plain top-n unseen), ``als_mmr`` (M9,
pool + MMR) and ``user_based`` (M12, neighbour plays), and ``popularity``.
Lists are made for every user with relevant test items in one distributed job (no
per-user loop) and scored with E16 and any further metrics given.

Everything that is read more than once — the split sides, the relevant
items, the lists — is checkpointed to the session's checkpoint folder
(a shared folder on a cluster), so a lost executor never replays the
split or the scoring, and each config reuses the same inputs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators import explore as X
from cadenza.operators import metrics as M
from cadenza.operators import recommend as RC
from cadenza.operators.als import ALSParams, FactorModel, data_fingerprint, train_als
from cadenza.operators.prepare import EvaluationData, prepare_evaluation_data
from cadenza.operators.results import save_results
from cadenza.plans.contract import Columns, Metric, Recommender, Scored, checked_lists, joined, popularity
from cadenza.session import ensure_checkpoint_dir
from cadenza.sources import commits

# inference parameters and their defaults (fixed values of the source's models)
INFERENCE_DEFAULTS = {"use_mmr": True, "lambda_param": 0.5, "candidate_pool_size": 20,
                      "n_similar_users": 10}


def _inference(params: dict) -> dict:
    return {**INFERENCE_DEFAULTS, **{k: v for k, v in params.items() if k in INFERENCE_DEFAULTS}}


@dataclass(frozen=True)
class _Fit:
    """An ALS fit and, when configs share one, each user's longest candidate list."""
    model: FactorModel
    pool: DataFrame | None = None
    pool_size: int = 0


def _als_kind(kind: str) -> Recommender:
    def train(rows: DataFrame, params: dict, c: Columns) -> _Fit:
        return _Fit(train_als(rows, ALSParams.from_dict(params), c.user, c.item, c.plays))

    def lists(fit: _Fit, users: DataFrame, k: int, params: dict) -> DataFrame:
        return recommend(fit.model, kind, k, users, candidates=fit.pool, candidates_size=fit.pool_size,
                         **_inference(params))

    def share(fit: _Fit, users: DataFrame, k: int, asked: list) -> _Fit:
        size = max(_pool_size(r.name, k, _inference(p)) for r, p in asked)
        if size == 0 or len(asked) == 1:
            return fit
        return replace(fit, pool=candidate_lists(fit.model, size, users), pool_size=size)

    def check(params: dict) -> None:
        p = _inference(params)
        if not 0.0 <= float(p["lambda_param"]) <= 1.0:
            raise ValueError("lambda_param must be in [0, 1]")
        if int(p["candidate_pool_size"]) <= 0:
            raise ValueError("candidate_pool_size must be > 0")
        if int(p["n_similar_users"]) < 1:
            raise ValueError("n_similar_users must be >= 1")
        ALSParams.from_dict(params)

    return Recommender(kind, train, lists, lambda params: ("als", ALSParams.from_dict(params)), share, check)


RECOMMENDERS: dict[str, Recommender] = {r.name: r for r in (*map(_als_kind, ("als", "als_mmr", "user_based")),
                                                            popularity())}


@dataclass(frozen=True)
class ModelConfig:
    """One sweep entry: a display name, a recommender (one of one's own, or the
    name of a built-in one) and all parameters."""
    name: str
    kind: str | Recommender = "als"
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        if isinstance(self.kind, str) and self.kind not in RECOMMENDERS:
            raise ValueError(f"unknown model kind {self.kind!r}; use one of {tuple(RECOMMENDERS)} or a Recommender")
        if self.recommender.check:
            self.recommender.check(self.params)

    @property
    def recommender(self) -> Recommender:
        return RECOMMENDERS[self.kind] if isinstance(self.kind, str) else self.kind

    def als(self) -> ALSParams:
        return ALSParams.from_dict(self.params)

    def inference(self) -> dict:
        return _inference(self.params)

    def param_json(self) -> str:
        return json.dumps(self.params, sort_keys=True)


# the five parameter sets of the source's shipped sweep (fixed values)
DEFAULT_CONFIGS = (
    ModelConfig("als", "als",
                {"alpha": 0.4, "factors": 50, "regularization": 0.1, "iterations": 20}),
    ModelConfig("als", "als",
                {"alpha": 0.8, "factors": 50, "regularization": 0.1, "iterations": 20}),
    ModelConfig("als_mmr", "als_mmr",
                {"alpha": 0.4, "factors": 50, "regularization": 0.1, "iterations": 20,
                 "lambda_param": 0.5, "candidate_pool_size": 20}),
    ModelConfig("als_mmr", "als_mmr",
                {"alpha": 0.4, "factors": 50, "regularization": 0.1, "iterations": 20,
                 "lambda_param": 0.3, "candidate_pool_size": 20}),
    ModelConfig("als_mmr", "als_mmr",
                {"alpha": 0.4, "factors": 50, "regularization": 0.1, "iterations": 20,
                 "lambda_param": 0.7, "candidate_pool_size": 20}),
)


def candidate_lists(model: FactorModel, size: int, users: DataFrame | None = None) -> DataFrame:
    """The ``size`` best unseen items per wanted user in index space
    (``user_idx, rank, item_idx, score``), checkpointed.  Any top-n list with
    n <= size is its first n rows, and any MMR pool of p <= size items its
    first p rows (ties break by item id in both), so one top-k
    serves every list of a sweep that uses the same factors."""
    wanted = None
    if users is not None:
        wanted = users.select(model.user_col).distinct().join(model.users, model.user_col).select("user_idx")
    return RC.candidate_pool(model.user_factors.select("user_idx", "embedding"),
                             model.item_factors.select("item_idx", "embedding"),
                             model.ratings.select("user_idx", "item_idx"), size, users=wanted,
                             user_col="user_idx", item_col="item_idx", vec_col="embedding",
                             pruned=True).checkpoint(eager=True)


def _pool_size(kind: str, n: int, inference: dict) -> int:
    """Candidates a list needs: n for a top-n, the pool for MMR, 0 for user-based."""
    if kind == "als":
        return n
    if kind == "als_mmr":
        # MMR reranks exactly the pool (fewer than n items if the pool is smaller)
        return int(inference["candidate_pool_size"]) if inference["use_mmr"] else n
    return 0


def recommend(model: FactorModel, kind: str = "als", n: int = 5, users: DataFrame | None = None,
              candidates: DataFrame | None = None, candidates_size: int = 0, **inference) -> DataFrame:
    """Lists of ``n`` items for the wanted users (all trained users when
    ``users`` is None), in the model's id space: ``user, rank, item, score``.
    Unknown users get no rows (see ``recommend_status``).

    ``candidates`` (from ``candidate_lists`` for the same users, holding
    ``candidates_size`` items per user) replaces the top-k when it
    is long enough for this list."""
    p = dict(INFERENCE_DEFAULTS)
    p.update(inference)
    uc, ic = model.user_col, model.item_col
    uf = model.user_factors.select("user_idx", "embedding")
    itf = model.item_factors.select("item_idx", "embedding")
    seen = model.ratings.select("user_idx", "item_idx")
    wanted = None
    if users is not None:
        wanted = users.select(uc).distinct().join(model.users, uc).select("user_idx")
    kw = dict(users=wanted, user_col="user_idx", item_col="item_idx", vec_col="embedding")
    need = _pool_size(kind, n, p)
    reuse = candidates is not None and 0 < need <= candidates_size
    if kind == "als" or (kind == "als_mmr" and not p["use_mmr"]):
        recs = (candidates.where(F.col("rank") <= n) if reuse
                else RC.top_n_unseen(uf, itf, seen, n, pruned=True, **kw))
    elif kind == "als_mmr":
        pool = (candidates.where(F.col("rank") <= need) if reuse
                else RC.candidate_pool(uf, itf, seen, need, pruned=True, **kw))
        recs = RC.mmr_rerank(pool, itf, float(p["lambda_param"]), n, "user_idx", "item_idx", "embedding")
    elif kind == "user_based":
        ratings = model.ratings.select("user_idx", "item_idx", F.col("strength").alias("play_count"))
        recs = RC.user_based_recommend(ratings, uf, n, int(p["n_similar_users"]), users=wanted,
                                       user_col="user_idx", item_col="item_idx", vec_col="embedding",
                                       aggregated=True)
    else:
        raise ValueError(f"unknown model kind {kind!r}")
    return (recs.join(model.users, "user_idx").join(model.items, "item_idx")
                .select(uc, F.col("rank").cast("int").alias("rank"), ic, "score"))


def _genres(train: DataFrame, item_col: str) -> DataFrame:
    if "genre" in train.columns:
        return X.item_genre(train, item_col, unknown=None).where(F.col("genre").isNotNull())
    schema = T.StructType([train.schema[item_col], T.StructField("genre", T.StringType())])
    return train.sparkSession.createDataFrame([], schema)


def evaluate_model(config: ModelConfig, data: EvaluationData, k: int = 5,
                   include_serendipity: bool = False, model=None,
                   user_col: str = "user_id", item_col: str = "artist",
                   plays_col: str = "play_count", metrics: Sequence[Metric] = ()) -> DataFrame:
    """Train (unless ``model`` holds a fit), recommend ``k`` items for every
    user with relevant test items, score with E16 and with each of ``metrics``.
    One row.

    The catalogue is the distinct train items; genres come from the train
    rows; popularity (novelty) from the train plays.
    """
    columns = Columns(user_col, item_col, plays_col)
    ensure_checkpoint_dir(data.train.sparkSession)
    if model is None:
        model = config.recommender.train(data.train, config.params, columns)
    elif isinstance(model, FactorModel):
        model = _Fit(model)
    users = data.relevant.select(user_col).distinct()
    recs = checked_lists(config.recommender.lists(model, users, k, config.params), users, k, columns)
    return score_lists(recs, data, k, include_serendipity, columns, metrics)


def score_lists(recs: DataFrame, data: EvaluationData, k: int, include_serendipity: bool = False,
                columns: Columns = Columns(), metrics: Sequence[Metric] = ()) -> DataFrame:
    """E16 of written lists, and each of ``metrics``.  One row."""
    c = columns
    users = data.relevant.select(c.user).distinct()
    catalog = data.train.select(c.item).distinct()
    own = M.all_metrics(recs, data.relevant, catalog, k, include_serendipity=include_serendipity,
                        interactions=data.train, genres=_genres(data.train, c.item),
                        users=users, user_col=c.user, item_col=c.item, plays_col=c.plays)
    scored = Scored(recs, data.relevant, data.train, users, k, c)
    return joined([own, *(m(scored) for m in metrics)])


def checkpointed_split(df: DataFrame, split_date=None, train_ratio: float = 0.8,
                       user_col: str = "user_id", item_col: str = "artist",
                       materialize_input: bool = True, plays_col: str = "play_count") -> EvaluationData:
    """J4 for repeated use: every config of a sweep reads the same split.

    With ``materialize_input`` the columns evaluation reads are written once
    to the checkpoint folder (one pass over an input that is itself a join,
    like the test views) and both sides are filters on that copy.  For a Parquet table,
    where the date filter is pushed into the scan, pass ``False`` and the
    sides read the table directly.  The relevant items are always written.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if materialize_input:
        # only what evaluation reads: ids, plays, date and genre (column-pruned write)
        keep = [c for c in (user_col, item_col, plays_col, "interaction_date", "genre") if c in df.columns]
        base = df.select(*keep).checkpoint(eager=True)
    else:
        base = df
    data = prepare_evaluation_data(base, split_date, train_ratio, user_col, item_col)
    return EvaluationData(data.train, data.test, data.relevant.checkpoint(eager=True))


def _config_key(config: ModelConfig, *setting) -> str:
    """Name of a config's committed result: what it is and what it was run on."""
    text = json.dumps([config.name, config.recommender.name, config.params, *setting], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def compare_models(configs, df: DataFrame, split_date=None, train_ratio: float = 0.8, k: int = 5,
                   include_serendipity: bool = False, results_path: str | None = None,
                   data_name: str = "data", execute_date: str | None = None,
                   user_col: str = "user_id", item_col: str = "artist",
                   plays_col: str = "play_count", metrics: Sequence[Metric] = (),
                   sweep_path: str | None = None, concurrent_fits: int = 2) -> DataFrame:
    """Split once, then evaluate every config on the same split.

    Configs whose recommenders name the same fit (for ALS: that differ only in
    MMR λ, pool size, neighbours) share it and one candidate list per user, so the
    scoring runs once per fit.  Different fits are independent: up to
    ``concurrent_fits`` run as Spark jobs at a time.

    Whatever goes wrong in a config (a bad parameter, a lost job, an error in a
    function given) is reported as ``status = 'failed: ...'`` with null metrics; a
    failed fit fails its configs; the others go on.

    With ``sweep_path`` each result is committed there as soon as it is known,
    under a key made of the config, the setting and the rows' fingerprint.  A later
    call takes committed results as they are, trains only for the others, and
    tries failed ones again.  Give a function of one's own a new name when it
    changes: the key knows it by name.  With ``results_path`` every new result is
    also saved in the results log (S4).

    Result: ``model_name, kind, param, status`` and the metric columns.
    """
    spark = df.sparkSession
    configs = list(configs)
    columns = Columns(user_col, item_col, plays_col)
    got: dict[int, dict] = {}
    failed: dict[int, str] = {}
    keys: list[str | None] = [None] * len(configs)
    if sweep_path:
        sweep_path = sweep_path.rstrip("/")
        used = [c for c in (user_col, item_col, plays_col, "interaction_date", "genre") if c in df.columns]
        setting = [str(split_date), train_ratio, k, include_serendipity, user_col, item_col, plays_col,
                   [getattr(m, "__qualname__", repr(m)) for m in metrics], data_fingerprint(df, *used)]
        keys = [_config_key(cfg, *setting) for cfg in configs]
        done = set(commits.names(spark, sweep_path))
        got = {i: json.loads(commits.read_text(spark, f"{sweep_path}/{key}.json"))
               for i, key in enumerate(keys) if f"{key}.json" in done}

    fits: dict = {}
    for i, cfg in enumerate(configs):
        if i not in got:
            try:
                fits.setdefault(cfg.recommender.key(cfg.params), []).append(i)
            except Exception as e:
                failed[i] = f"failed: {type(e).__name__}: {e}"

    def run(data: EvaluationData, group: list[int]) -> None:
        try:
            first = configs[group[0]]
            users = data.relevant.select(user_col).distinct()
            learned = first.recommender.train(data.train, first.params, columns)
            if first.recommender.share:
                learned = first.recommender.share(learned, users, k, [(configs[i].recommender, configs[i].params)
                                                                      for i in group])
        except Exception as e:  # a sweep outlives any one fit
            failed.update({i: f"failed: {type(e).__name__}: {e}" for i in group})
            return
        for i in group:
            cfg = configs[i]
            try:
                # one row of a dozen numbers per config
                row = evaluate_model(cfg, data, k, include_serendipity, learned, user_col, item_col, plays_col,
                                     metrics).first().asDict()
                if sweep_path:
                    commits.publish_file(spark, f"{sweep_path}/{keys[i]}.json", json.dumps(row))
                if results_path:
                    save_results(spark, results_path, data_name, cfg.name, cfg.params, row, execute_date)
                got[i] = row
            except Exception as e:
                failed[i] = f"failed: {type(e).__name__}: {e}"

    if fits:
        data = checkpointed_split(df, split_date, train_ratio, user_col, item_col, plays_col=plays_col)
        with ThreadPoolExecutor(max(1, concurrent_fits)) as pool:
            for job in [pool.submit(inheritable_thread_target(spark)(run), data, group) for group in fits.values()]:
                job.result()

    names = list(dict.fromkeys(n for i in sorted(got) for n in got[i]))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("model_name", "kind", "param", "status")]
                          + [T.StructField(n, T.DoubleType()) for n in names])
    rows = [(cfg.name, cfg.recommender.name, cfg.param_json(), failed.get(i, "ok"),
             *(None if got.get(i, {}).get(n) is None else float(got[i][n]) for n in names))
            for i, cfg in enumerate(configs)]
    return spark.createDataFrame(rows, schema)


def flagship(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Split interactions by date ratio, train implicit ALS, rerank each test
    user's candidate pool with MMR (λ=0.5, pool 20) and score the lists with
    the accuracy and beyond-accuracy metrics.  One row."""
    from cadenza.sources.fixtures import view
    from cadenza.sources.interactions import conform_interactions

    df = conform_interactions(view(spark, sf_dir, "interactions"))
    data = checkpointed_split(df, train_ratio=0.8)
    cfg = DEFAULT_CONFIGS[2]
    return evaluate_model(cfg, data, k, include_serendipity=True)
