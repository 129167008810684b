"""Keyed EM fits: every iteration is one pass that returns a few sums per fit key.

Parameters of all keys live on the driver (a few dozen numbers each, at most MAX_KEYS keys per pass; larger
key lists are fitted in several passes). Rows are never exploded on disk by key: a piece meets its keys
inside the task, and the sums are combined map-side.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcseq.columns import LOG_TWO_PI, SEQ, STATES, TRANSITIONS
from arcseq.functions.bessel import kappa_approx, kappa_exact, log_norm
from arcseq.functions.circular import logsumexp, softmax
from arcseq.operators.kernels import Ragged, pairs, softmax_rows
from arcseq.operators.params import Params, values_table
from arcseq.operators.recursions import (
    Batch,
    KeySet,
    Packed,
    entry_exit,
    index_of,
    read_borders,
    run_kernel,
    sequence_ll,
)
from arcseq.session import discard, hold, write

MAX_KEYS = 2000


@dataclass
class Fit:
    """Result of one fit key."""

    key: dict
    params: Params
    history: list[float] = field(default_factory=list)
    converged: bool = False
    n_rows: int = 0

    @property
    def train_ll(self) -> float:
        return self.history[-1]


@dataclass
class Model:
    """Stacked parameters of the keys being fitted; arrays have the key as first axis."""

    keys: list[dict]
    coh: list[float]
    prior: list[float]
    kappa_s: np.ndarray
    kappa_p: np.ndarray
    extra: dict[str, np.ndarray]

    def take(self, idx) -> Model:
        return replace(
            self,
            keys=[self.keys[i] for i in idx],
            kappa_s=self.kappa_s[idx],
            kappa_p=self.kappa_p[idx],
            extra={k: v[idx] for k, v in self.extra.items()},
        )

    def put(self, idx, part: Model) -> None:
        self.kappa_s[idx], self.kappa_p[idx] = part.kappa_s, part.kappa_p
        for k in self.extra:
            self.extra[k][idx] = part.extra[k]

    def keyset(self) -> KeySet:
        e = self.extra
        k = len(self.keys)
        return KeySet(
            names=list(range(k)),
            pi=e.get("pi", np.full((k, 3), 1 / 3)),
            A=e.get("A", np.full((k, 3, 3), 1 / 3)),
            kappa_s=self.kappa_s,
            kappa_p=self.kappa_p,
            subject=[key.get("subject_id") for key in self.keys],
            folds=[key.get("folds") for key in self.keys],
            B=e.get("B"),
            mean=e.get("mean"),
            sd=e.get("sd"),
            rho=e.get("rho"),
            class_pi=e.get("class_pi"),
            class_A=e.get("class_A"),
        ).prepare()

    def params(self, i: int) -> Params:
        e = {k: v[i] for k, v in self.extra.items()}
        out = Params(dict(zip(self.coh, self.kappa_s[i])), dict(zip(self.prior, self.kappa_p[i])))
        for name in ("weights", "pi", "A", "B", "rho", "class_weights", "class_pi", "class_A"):
            if name in e:
                setattr(out, name, e[name].tolist())
        if "condition_weights" in e:
            out.condition_weights = dict(zip(self.prior, e["condition_weights"].tolist()))
        return out


def model_from(inits: list[Params], keys: list[dict], coh: list[float], prior: list[float], names: list[str]) -> Model:
    """One initial parameter set per key; `names` are the parts that the model uses."""
    extra = {}
    for n in names:
        if n == "condition_weights":
            extra[n] = np.array([[p.condition_weights.get(w, p.weights) for w in prior] for p in inits], dtype=float)
        else:
            extra[n] = np.array([getattr(p, n) for p in inits], dtype=float)
    return Model(
        keys,
        coh,
        prior,
        np.array([[p.kappa_s[c] for c in coh] for p in inits]),
        np.array([[p.kappa_p[w] for w in prior] for p in inits]),
        extra,
    )


# ------------------------------------------------------------------------------------------------
# the loop


@dataclass
class Stop:
    """`relative`: small relative gain after min_iter, parameters updated first. `absolute`: small change,
    checked before the update. `tol` None runs exactly max_iter updates."""

    max_iter: int = 100
    tol: float | None = 1e-7
    min_iter: int = 10
    rule: str = "relative"


def run_em(model: Model, step, update, stop: Stop) -> list[Fit]:
    """`step(model) -> {sum name: (K, ...) array}`, `update(model, sums) -> model`."""
    model = replace(
        model, kappa_s=model.kappa_s.copy(), kappa_p=model.kappa_p.copy(), extra={k: v.copy() for k, v in model.extra.items()}
    )
    fits = [Fit(key, None) for key in model.keys]
    for lo in range(0, len(model.keys), MAX_KEYS):
        active = list(range(lo, min(lo + MAX_KEYS, len(model.keys))))
        for it in range(stop.max_iter):
            part = model.take(active)
            sums = step(part)
            done = []
            for j, i in enumerate(active):
                h = fits[i].history
                h.append(float(sums["ll"][j]))
                fits[i].n_rows = int(sums["n"][j])
                if stop.tol is not None and len(h) >= 2:
                    gain = h[-1] - h[-2]
                    if stop.rule == "absolute":
                        if abs(gain) < stop.tol:
                            done.append(j)
                    elif it >= stop.min_iter and gain >= -1e-5 and gain / max(1.0, abs(h[-2])) < stop.tol:
                        done.append(j)
            # the absolute rule keeps the parameters that gave the last likelihood
            last = stop.rule == "absolute" and stop.tol is not None and it + 1 == stop.max_iter
            frozen = done if stop.rule == "absolute" else []
            moving = [] if last else [j for j in range(len(active)) if j not in set(frozen)]
            if moving:
                sub = {k: v[moving] for k, v in sums.items()}
                model.put([active[j] for j in moving], update(part.take(moving), sub))
            for j in done:
                fits[active[j]].converged = True
            active = [i for j, i in enumerate(active) if j not in set(done)]
            if not active:
                break
    for i, fit in enumerate(fits):
        fit.params = model.params(i)
    return fits


def _kappas(model: Model, sums: dict, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    f = kappa_exact if exact else kappa_approx
    floor = 1e-15 if exact else 1e-300
    return (
        f(sums["sc"] / np.maximum(sums["sw"], floor)),
        f(sums["pc"] / np.maximum(sums["pw"], floor)),
    )


def _simplex(x, add):
    x = x + add
    return x / x.sum(axis=-1, keepdims=True)


def level_rows(feat: DataFrame, coh: list[float], prior: list[float], *extra: str) -> DataFrame:
    """The columns that set-based fits read, with level indices; read once per iteration, so kept."""
    return hold(
        feat.select(
            *SEQ,
            "cos_s",
            "cos_p",
            index_of(coh, "motion_coherence").alias("ci"),
            index_of(prior, "prior_std").alias("pi_"),
            *extra,
        )
    )


# ------------------------------------------------------------------------------------------------
# set-based models: mixture, conditioned mixture, block mixture


def _array(rows) -> str:
    return "array(" + ", ".join(_array(x) if np.ndim(x) else f"{float(x)!r}D" for x in rows) + ")"


def key_columns(model: Model, i: int) -> dict[str, str]:
    """Parameters of key i as SQL array literals (weights and shares in logs)."""
    cols = {"ks": model.kappa_s, "ns": log_norm(model.kappa_s), "kp": model.kappa_p, "np": log_norm(model.kappa_p)}
    for n, v in model.extra.items():
        cols[n] = np.log(np.maximum(v, 1e-300)) if n in ("weights", "condition_weights", "rho", "class_weights") else v
    key = model.keys[i]
    folds = "array()" if key.get("folds") is None else f"array({', '.join(map(str, key['folds']))})"
    subject = "NULL" if key.get("subject_id") is None else f"{key['subject_id']}"
    return {
        "fit_key": f"{i}L",
        "key_subject": f"CAST({subject} AS BIGINT)",
        "key_folds": f"CAST({folds} AS ARRAY<INT>)",
        **{n: _array(v[i]) for n, v in cols.items()},
    }


def key_table(df: DataFrame, model: Model) -> DataFrame:
    """One row per fit key (at most MAX_KEYS rows)."""
    rows = [key_columns(model, i) for i in range(len(model.keys))]
    body = ", ".join("(" + ", ".join(row.values()) + ")" for row in rows)
    return df.sparkSession.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(rows[0])})")


def match_keys(rows: DataFrame, model: Model, fold: str | None = None) -> DataFrame:
    """Rows paired with every key whose training set holds them (the key table is broadcast)."""
    by_subject = [k.get("subject_id") is not None for k in model.keys]
    if len(model.keys) == 1 and not by_subject[0]:
        joined = rows.withColumns({n: F.expr(v) for n, v in key_columns(model, 0).items()})
    elif not any(by_subject):
        mine = [F.lit(i).cast("long") if k.get("folds") is None or not fold else F.when(F.col(fold).isin(k["folds"]), F.lit(i).cast("long")) for i, k in enumerate(model.keys)]
        ids = F.filter(F.array(*mine), lambda i: i.isNotNull())
        joined = rows.withColumn("fit_key", F.explode(ids)).join(F.broadcast(key_table(rows, model)), "fit_key")
    elif all(by_subject):
        joined = rows.join(F.broadcast(key_table(rows, model)), F.col("subject_id") == F.col("key_subject"))
    else:
        raise ValueError("fit keys must be all per subject or all over every subject")
    if fold and any(k.get("folds") is not None for k in model.keys):
        joined = joined.filter((F.size("key_folds") == 0) | F.array_contains("key_folds", F.col(fold)))
    return joined


def emission_columns() -> list[Column]:
    ci, pi_ = F.col("ci"), F.col("pi_")
    return [
        F.col("ks")[ci] * F.col("cos_s") - F.col("ns")[ci],
        F.col("kp")[pi_] * F.col("cos_p") - F.col("np")[pi_],
        F.lit(-LOG_TWO_PI),
    ]


def _level_sums(g_s: Column, g_p: Column, model: Model, tag: str = "") -> list[Column]:
    out = []
    for i in range(len(model.coh)):
        w = F.when(F.col("ci") == i, g_s)
        out += [F.sum(w).alias(f"{tag}sw{i}"), F.sum(w * F.col("cos_s")).alias(f"{tag}sc{i}")]
    for i in range(len(model.prior)):
        w = F.when(F.col("pi_") == i, g_p)
        out += [F.sum(w).alias(f"{tag}pw{i}"), F.sum(w * F.col("cos_p")).alias(f"{tag}pc{i}")]
    return out


def collect_sums(table: DataFrame, n_keys: int, shapes: dict[str, tuple]) -> dict[str, np.ndarray]:
    """Few sums per key to arrays; column `name{i}` holds flat element i."""
    out = {n: np.zeros((n_keys, int(np.prod(s)) if s else 1)) for n, s in shapes.items()}
    for row in table.collect():
        for n, s in shapes.items():
            size = int(np.prod(s)) if s else 1
            values = [row[n]] if not s else [row[f"{n}{i}"] for i in range(size)]
            out[n][row["fit_key"]] = [0.0 if v is None else v for v in values]
    return {n: v.reshape((n_keys, *shapes[n])) if shapes[n] else v[:, 0] for n, v in out.items()}


def _level_shapes(model: Model) -> dict[str, tuple]:
    c, p = (len(model.coh),), (len(model.prior),)
    return {"sw": c, "sc": c, "pw": p, "pc": p}


def mixture_step(rows: DataFrame, model: Model, fold: str | None) -> dict[str, np.ndarray]:
    conditioned = "condition_weights" in model.extra
    matched = match_keys(rows, model, fold)
    log_w = F.col("condition_weights")[F.col("pi_")] if conditioned else F.col("weights")
    logs = [log_w[i] + e for i, e in enumerate(emission_columns())]
    gamma = softmax([F.col(f"l{i}") for i in range(3)])
    wide = matched.select("fit_key", "ci", "pi_", "cos_s", "cos_p", *[e.alias(f"l{i}") for i, e in enumerate(logs)])
    wide = wide.withColumns({"__ll": logsumexp([F.col(f"l{i}") for i in range(3)]), **{f"g{i}": g for i, g in enumerate(gamma)}})
    aggs = [F.sum("__ll").alias("ll"), F.count(F.lit(1)).alias("n"), *_level_sums(F.col("g0"), F.col("g1"), model)]
    shapes = {"ll": (), "n": (), **_level_shapes(model)}
    if conditioned:
        shapes["g"] = (len(model.prior), 3)
        for i in range(len(model.prior)):
            aggs += [F.sum(F.when(F.col("pi_") == i, F.col(f"g{s}"))).alias(f"g{i * 3 + s}") for s in range(3)]
    else:
        shapes["g"] = (3,)
        aggs += [F.sum(f"g{s}").alias(f"g{s}") for s in range(3)]
    return collect_sums(wide.groupBy("fit_key").agg(*aggs), len(model.keys), shapes)


def fit_mixture(
    rows: DataFrame, model: Model, stop: Stop, fold: str | None = None, exact: bool = False, smoothing: float = 1e-3
) -> list[Fit]:
    """Independent or prior-conditioned mixture (the latter when the model has condition_weights)."""

    def update(m: Model, sums: dict) -> Model:
        ks, kp = _kappas(m, sums, exact)
        name = "condition_weights" if "condition_weights" in m.extra else "weights"
        return replace(m, kappa_s=ks, kappa_p=kp, extra={**m.extra, name: _simplex(sums["g"], smoothing)})

    return run_em(model, lambda m: mixture_step(rows, m, fold), update, stop)


def _weigh_classes(per_seq: DataFrame, model: Model, classes: int, stats: list[str]) -> DataFrame:
    """Sequence sums per class -> sums per key weighted by the class posterior of the sequence."""
    table = F.broadcast(
        values_table(
            per_seq.sparkSession,
            ["fit_key", *[f"rho{c}" for c in range(classes)]],
            [(i, *np.log(np.maximum(r, 1e-300))) for i, r in enumerate(model.extra["rho"])],
        )
    )
    joined = per_seq.join(table, "fit_key")
    logs = [F.col(f"rho{c}") + F.col(f"c{c}_ll") for c in range(classes)]
    joined = joined.withColumns({"__ll": logsumexp(logs), **{f"tau{c}": t for c, t in enumerate(softmax(logs))}})
    aggs = [F.sum("__ll").alias("ll"), F.sum("n").alias("n"), *[F.sum(f"tau{c}").alias(f"rc{c}") for c in range(classes)]]
    shared = [s for s in stats if s[:2] in ("sw", "sc", "pw", "pc")]
    for s in stats:
        if s not in shared:
            aggs += [F.sum(F.col(f"tau{c}") * F.col(f"c{c}_{s}")).alias(f"c{c}_{s}") for c in range(classes)]
    for s in shared:
        aggs.append(F.sum(sum(F.col(f"tau{c}") * F.coalesce(F.col(f"c{c}_{s}"), F.lit(0.0)) for c in range(classes))).alias(s))
    return joined.groupBy("fit_key").agg(*aggs)


def block_step(rows: DataFrame, model: Model, fold: str | None, keys: list[str]) -> dict[str, np.ndarray]:
    classes = model.extra["rho"].shape[1]
    matched = match_keys(rows, model, fold)
    emissions = emission_columns()
    aggs, stats = [F.count(F.lit(1)).alias("n")], []
    wide = matched.withColumns({f"e{i}": e for i, e in enumerate(emissions)})
    for c in range(classes):
        logs = [F.col("class_weights")[c][i] + F.col(f"e{i}") for i in range(3)]
        wide = wide.withColumn(f"mix{c}", logsumexp(logs)).withColumns({f"r{c}{i}": g for i, g in enumerate(softmax(logs))})
        aggs += [F.sum(f"mix{c}").alias(f"c{c}_ll"), *[F.sum(f"r{c}{i}").alias(f"c{c}_w{i}") for i in range(3)]]
        aggs += _level_sums(F.col(f"r{c}0"), F.col(f"r{c}1"), model, f"c{c}_")
    stats = [f"w{i}" for i in range(3)]
    stats += [f"{t}{i}" for t, n in (("sw", len(model.coh)), ("sc", len(model.coh))) for i in range(n)]
    stats += [f"{t}{i}" for t, n in (("pw", len(model.prior)), ("pc", len(model.prior))) for i in range(n)]
    per_seq = wide.groupBy(*keys, "fit_key").agg(*aggs)
    weighed = _weigh_classes(per_seq, model, classes, stats)
    shapes = {"ll": (), "n": (), "rc": (classes,), **_level_shapes(model), **{f"c{c}_w": (3,) for c in range(classes)}}
    sums = collect_sums(weighed, len(model.keys), shapes)
    sums["cw"] = np.stack([sums.pop(f"c{c}_w") for c in range(classes)], axis=1)
    return sums


def fit_block(
    rows: DataFrame, model: Model, stop: Stop, fold: str | None = None, keys: list[str] = SEQ, exact: bool = True
) -> list[Fit]:
    """Exchangeable block mixture: class shares, class weights and concentrations."""

    def update(m: Model, sums: dict) -> Model:
        ks, kp = _kappas(m, sums, exact)
        extra = {**m.extra, "rho": _simplex(sums["rc"], 1e-6), "class_weights": _simplex(sums["cw"], 1e-6)}
        return replace(m, kappa_s=ks, kappa_p=kp, extra=extra)

    return run_em(model, lambda m: block_step(rows, m, fold, keys), update, stop)


# ------------------------------------------------------------------------------------------------
# chain models


def _by_key(b: Batch, n_keys: int, values, of_piece: bool):
    """Sum rows (or pieces) per fit key."""
    index = b.key if of_piece else b.row_key
    flat = values.reshape(len(index), -1)
    return np.stack([np.bincount(index, weights=flat[:, i], minlength=n_keys) for i in range(flat.shape[1])], axis=1)


def _level_totals(b: Batch, gamma, cos, level, n_levels, n_keys):
    slot = b.row_key * n_levels + level
    w = np.bincount(slot, weights=gamma, minlength=n_keys * n_levels).reshape(n_keys, n_levels)
    c = np.bincount(slot, weights=gamma * cos, minlength=n_keys * n_levels).reshape(n_keys, n_levels)
    return w, c


def _emit(table, keep):
    """Sums of the keys met in a batch as (fit_key, slot, value) rows."""
    keys = np.flatnonzero(keep)
    n = table.shape[1]
    cols = [np.repeat(keys, n).astype(np.int64), np.tile(np.arange(n, dtype=np.int32), len(keys)), table[keys].ravel()]
    return ["fit_key", "slot", "value"], [pa.array(c) for c in cols]


def _sum_slots(
    packed: Packed, keyset: KeySet, fn, shapes: dict, x_cols: tuple, fold: str | None, classes: int = 0
) -> dict[str, np.ndarray]:
    """Run `fn` and add its slots over all batches; slots follow the order of `shapes`."""
    out = run_kernel(packed, keyset, fn, "fit_key bigint, slot int, value double", x_cols, fold, classes=classes)
    table = out.groupBy("fit_key", "slot").agg(F.sum("value").alias("value")).toArrow()
    n_keys, width = len(keyset.names), sum(int(np.prod(s)) for s in shapes.values())
    flat = np.zeros((n_keys, width))
    flat[table["fit_key"].to_numpy(), table["slot"].to_numpy()] = table["value"].to_numpy()
    sums, at = {}, 0
    for name, s in shapes.items():
        size = int(np.prod(s))
        part = flat[:, at : at + size]
        sums[name] = part.reshape((n_keys, *s)) if s else part[:, 0]
        at += size
    return sums


def chain_shapes(model: Model) -> dict[str, tuple]:
    return {"ll": (), "n": (), "pi": (3,), "A": (3, 3), **_level_shapes(model)}


def _posteriors(b: Batch):
    """Likelihoods, state posteriors, pairwise posteriors (zero at starts of sequences) of the rows of a batch, and what these
    are made of."""
    chain = b.chain()
    pi = b.keyset.pi[b.key]
    pre, suf, _ = read_borders(b)
    entry, leave = entry_exit(b, pi, pre, suf)
    _, filt, scale, ll = chain.forward(b.start(chain, pi, entry))
    beta = chain.backward(scale, leave)
    starts = b.rg.starts[b.fresh]
    xi = chain.xi(filt, beta, entry, starts)
    xi[starts] = 0.0
    return ll, chain.gamma(filt, beta), xi, chain.around(filt, beta, entry)


def chain_step(packed: Packed, model: Model, fold: str | None = None, x_cols: tuple = ()) -> dict[str, np.ndarray]:
    """E-step sums of a chain model."""
    n_keys, n_c, n_p = len(model.keys), len(model.coh), len(model.prior)

    def fn(b: Batch):
        ll, gamma, xi, _ = _posteriors(b)
        sw, sc = _level_totals(b, gamma[:, 0], b.pick("cos_s"), b.pick("ci"), n_c, n_keys)
        pw, pc = _level_totals(b, gamma[:, 1], b.pick("cos_p"), b.pick("pi_"), n_p, n_keys)
        first = gamma[b.rg.starts] * b.fresh[:, None]
        each = [(ll, False), (np.ones(len(ll)), False), (first, True), (xi, False)]
        parts = [_by_key(b, n_keys, x, of_piece) for x, of_piece in each]
        return _emit(np.concatenate([*parts, sw, sc, pw, pc], axis=1), np.bincount(b.key, minlength=n_keys) > 0)

    return _sum_slots(packed, model.keyset(), fn, chain_shapes(model), x_cols, fold)


@dataclass
class Posteriors:
    """A written forward-backward pass: one row for each piece, with the raw covariates of its transitions, the keys that it
    belongs to, and under each the vectors before and after a transition, of which its pairwise posterior follows (six numbers
    instead of nine). E-step sums stand in the first row of a batch. `mean` and `sd` scale the covariates of each key, `B` made
    its transition matrices."""

    df: DataFrame
    path: str
    x_cols: tuple
    mean: np.ndarray
    sd: np.ndarray
    B: np.ndarray

    def discard(self) -> None:
        discard(self.df.sparkSession, self.path)


def _lists(flat, sizes) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.ascontiguousarray(flat).ravel()))


def chain_posteriors(packed: Packed, model: Model, x_cols: tuple, fold: str | None = None) -> Posteriors:
    """One forward-backward pass, written. What follows in the iteration reads this table."""
    n_keys, n_c, n_p = len(model.keys), len(model.coh), len(model.prior)

    def fn(b: Batch):
        ll, gamma, xi, around = _posteriors(b)
        levels = _level_totals(b, gamma[:, 0], b.pick("cos_s"), b.pick("ci"), n_c, n_keys)
        levels += _level_totals(b, gamma[:, 1], b.pick("cos_p"), b.pick("pi_"), n_p, n_keys)
        each = [(ll, False), (np.ones(len(ll)), False), (gamma[b.rg.starts] * b.fresh[:, None], True), (xi, False)]
        sums = np.concatenate([*[_by_key(b, n_keys, x, of_piece) for x, of_piece in each], *levels], axis=1)
        met = np.unique(b.key)
        told = pa.StructArray.from_arrays([pa.array(met), _lists(sums[met], np.full(len(met), sums.shape[1]))], ["fit_key", "sums"])
        # a row of the batch is a piece; its keys follow one another in `b`
        pieces = len(b.source.lens)
        fresh = b.column("first_pos").to_numpy(zero_copy_only=False) == 1
        go, own_go = np.ones(b.source.n, bool), np.ones(b.rg.n, bool)
        go[b.source.starts[fresh]] = False
        own_go[b.rg.starts[b.fresh]] = False
        moves = b.source.lens - fresh
        keys = np.bincount(b.piece, minlength=pieces)
        at = np.where(np.arange(pieces + 1) > 0, len(met), 0).astype(np.int32)
        arrays = [_lists(b.key, keys), pa.ListArray.from_arrays(pa.array(at), told), *[_lists(x[own_go], moves * keys * 3) for x in around]]
        return ["fit_key", "sums", "before", "after", *x_cols], arrays + [_lists(b.flat[c][go], moves) for c in x_cols]

    schema = "fit_key array<bigint>, sums array<struct<fit_key: bigint, sums: array<double>>>, before array<double>, after array<double>, "
    schema += ", ".join(f"{c} array<double>" for c in x_cols)
    df, path = write(run_kernel(packed, model.keyset(), fn, schema, x_cols, fold), "chain-posteriors")
    return Posteriors(df, path, tuple(x_cols), *[model.extra[c] for c in ("mean", "sd", "B")])


def summed_posteriors(posteriors: Posteriors, model: Model) -> dict[str, np.ndarray]:
    shapes = chain_shapes(model)
    names, at = [], 0
    for n, s in shapes.items():
        size = int(np.prod(s)) if s else 1
        names += [(at + i, f"{n}{i}" if s else n) for i in range(size)]
        at += size
    each = posteriors.df.select(F.inline("sums")).groupBy("fit_key")
    return collect_sums(each.agg(*[F.sum(F.get("sums", F.lit(i))).alias(n) for i, n in names]), len(model.keys), shapes)


def logit_pass(posteriors: Posteriors, v: np.ndarray, keys: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Objective, gradient and Hessian of the transition rows of `keys` at `v`, from the written posteriors."""
    n_keys, _, free = v.shape
    x_cols, mean, sd, B = posteriors.x_cols, posteriors.mean, posteriors.sd, posteriors.B

    def fn(batches):
        total: dict = {}
        for batch in batches:
            held, *x = (batch.column(batch.schema.get_field_index(c)) for c in ("fit_key", *x_cols))
            source = Ragged(np.diff(x[0].offsets.to_numpy()))
            raw = np.column_stack([c.flatten().to_numpy() for c in x])
            before, after = (batch.column(batch.schema.get_field_index(c)).flatten().to_numpy().reshape(-1, 3) for c in ("before", "after"))
            piece = np.repeat(np.arange(batch.num_rows), np.diff(held.offsets.to_numpy()))
            rg = Ragged(source.lens[piece])
            row = np.arange(rg.n) - rg.starts[rg.piece] + source.starts[piece][rg.piece]
            row_key = held.flatten().to_numpy()[rg.piece]
            for k in keys:
                own = np.flatnonzero(row_key == k)
                if len(own):
                    z = (raw[row[own]] - mean[k]) / sd[k]
                    z = np.column_stack([np.ones(len(z)), z])
                    xi = pairs(before[own], softmax_rows(np.einsum("ijp,np->nij", B[k], z)), after[own])
                    found = logit_sums(z, xi, v[k])
                    total[k] = [a + b for a, b in zip(total[k], found)] if k in total else found
        for k, found in total.items():
            flat = np.concatenate([f.ravel() for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), k)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["fit_key", "slot", "value"])

    rows = posteriors.df.select("fit_key", "before", "after", *x_cols)
    out = rows.mapInArrow(fn, "fit_key bigint, slot int, value double").groupBy("fit_key", "slot").agg(F.sum("value").alias("value")).toArrow()
    flat = np.zeros((n_keys, 3 + 3 * free + 3 * free * free))
    flat[out["fit_key"].to_numpy(), out["slot"].to_numpy()] = out["value"].to_numpy()
    return flat[:, :3], flat[:, 3 : 3 + 3 * free].reshape(-1, 3, free), flat[:, 3 + 3 * free :].reshape(-1, 3, free, free)


def logit_moments(x, counts, v):
    """Of weighted logits of the next class from each previous class (the last class has score zero): objective, probabilities
    of the other classes, expected minus seen counts, and covariance of the classes, the last three by row.

    `counts` is rows x previous x next, `v` previous x (other classes * columns of x).
    """
    score = np.zeros((len(x), v.shape[0], v.shape[1] // x.shape[1] + 1))
    score[..., :-1] = (x @ v.reshape(-1, x.shape[1]).T).reshape(len(x), v.shape[0], -1)
    score -= score.max(axis=2, keepdims=True)
    log_p = score - np.log(np.exp(score).sum(axis=2, keepdims=True))
    p = np.exp(log_p[..., :-1])
    mass = counts.sum(axis=2, keepdims=True)
    excess = mass * p - counts[..., :-1]
    covariance = mass[..., None] * (p[..., None] * np.eye(p.shape[2]) - p[..., None] * p[..., None, :])
    return -np.einsum("nij,nij->i", counts, log_p), p, excess, covariance


def logit_sums(x, counts, v):
    """Objective, gradient and Hessian of `logit_moments`, summed over rows."""
    q, _, excess, covariance = logit_moments(x, counts, v)
    n, size = v.shape
    gradient = (excess.reshape(len(x), -1).T @ x).reshape(n, size)
    return q, gradient, curvature_sum(x, covariance)


def curvature_sum(x, covariance):
    """Hessian of each previous class: products of the columns of x (each pair once) weighted by the covariances of classes."""
    rows, n, a, _ = covariance.shape
    one, two = np.triu_indices(x.shape[1])
    pairs = covariance.reshape(rows, -1).T @ (x[:, one] * x[:, two])
    whole = np.empty((n, a, a, x.shape[1], x.shape[1]))
    whole[..., one, two] = whole[..., two, one] = pairs.reshape(n, a, a, -1)
    return whole.swapaxes(2, 3).reshape(n, a * x.shape[1], -1)


def fit_hmm(
    packed: Packed, model: Model, stop: Stop, fold: str | None = None, exact: bool = False, smoothing: float = 1e-3
) -> list[Fit]:
    """Chain with initial distribution, transition matrix and concentrations."""

    def update(m: Model, sums: dict) -> Model:
        ks, kp = _kappas(m, sums, exact)
        extra = {**m.extra, "pi": _simplex(sums["pi"], smoothing), "A": _simplex(sums["A"], smoothing)}
        return replace(m, kappa_s=ks, kappa_p=kp, extra=extra)

    return run_em(model, lambda m: chain_step(packed, m, fold), update, stop)


def free_rows(B):
    """Coefficients relative to the last class, flattened per previous state."""
    return (B[:, :, :2] - B[:, :, 2:]).reshape(*B.shape[:2], -1)


def centred_rows(v, p_dim):
    full = np.concatenate([v.reshape(*v.shape[:2], 2, p_dim), np.zeros((*v.shape[:2], 1, p_dim))], axis=2)
    return full - full.mean(axis=2, keepdims=True)


def newton_rows(posteriors: Posteriors, v: np.ndarray, l2: float, passes: int, tol: float = 1e-6) -> np.ndarray:
    """Minimum of the penalised objective of each transition row of each key, by Newton's method.

    A step that makes its row worse is halved; a row stops once its step is below `tol`, and a key is read no more once its
    three rows have stopped."""
    best, cost = v.copy(), np.full(v.shape[:2], np.inf)
    moving = np.ones(v.shape[:2], bool)
    eye = np.eye(v.shape[-1])
    for _ in range(passes):
        keys = np.flatnonzero(moving.any(axis=1))
        if not len(keys):
            break
        q, g, h = logit_pass(posteriors, v, keys.tolist())
        value = q + 0.5 * l2 * (v**2).sum(axis=-1)
        better = moving & (value <= cost + 1e-9 * np.abs(np.where(np.isfinite(cost), cost, 0)))
        best[better], cost[better] = v[better], value[better]
        step = np.linalg.solve(h + l2 * eye, (g + l2 * v)[..., None])[..., 0]
        to = np.where(better[..., None], v - step, (v + best) / 2)
        moving &= np.abs(to - best).max(axis=-1) >= tol
        v = np.where(moving[..., None], to, best)
    return best


def fit_covariate_hmm(
    packed: Packed,
    model: Model,
    stop: Stop,
    x_cols: tuple,
    fold: str | None = None,
    l2: float = 1.0,
    passes: int = 30,
    dirichlet: float = 1e-3,
) -> list[Fit]:
    """Chain whose transition rows are multinomial logits of covariates.

    An iteration makes one forward-backward pass, whose posteriors are written; the Newton passes of the transition M-step
    (a strictly convex objective) only read them. They are deleted before the next iteration writes its own.
    """

    def step(m: Model) -> dict:
        posteriors = chain_posteriors(packed, m, x_cols, fold)
        sums = summed_posteriors(posteriors, m)
        v = newton_rows(posteriors, free_rows(m.extra["B"]), l2, passes)
        posteriors.discard()
        return {**sums, "new_B": centred_rows(v, m.extra["B"].shape[-1])}

    def update(m: Model, sums: dict) -> Model:
        ks, kp = _kappas(m, sums, False)
        extra = {**m.extra, "pi": _simplex(sums["pi"], dirichlet), "B": sums["new_B"]}
        return replace(m, kappa_s=ks, kappa_p=kp, extra=extra)

    return run_em(model, step, update, stop)


def hybrid_step(packed: Packed, model: Model, fold: str | None) -> dict[str, np.ndarray]:
    keyset = model.keyset()
    keys = packed.keys
    classes = model.extra["rho"].shape[1]
    n_c, n_p = len(model.coh), len(model.prior)
    stats = [f"pi{i}" for i in range(3)] + [f"A{i}" for i in range(9)]
    stats += [f"sw{i}" for i in range(n_c)] + [f"sc{i}" for i in range(n_c)]
    stats += [f"pw{i}" for i in range(n_p)] + [f"pc{i}" for i in range(n_p)]
    cols = [f"c{c}_{s}" for c in range(classes) for s in ["ll", *stats]]

    def by_piece(b: Batch, values):
        flat = values.reshape(b.rg.n, -1)
        return np.stack([np.bincount(b.rg.piece, weights=flat[:, i], minlength=len(b.piece)) for i in range(flat.shape[1])], axis=1)

    def fn(b: Batch):
        pre, suf, _ = read_borders(b, classes)
        pre, suf = pre.reshape(-1, classes, 3, 3), suf.reshape(-1, classes, 3, 3)
        ci, pi_ = b.pick("ci"), b.pick("pi_")
        on_c = (ci[:, None] == np.arange(n_c)).astype(float)
        on_p = (pi_[:, None] == np.arange(n_p)).astype(float)
        starts = b.rg.starts[b.fresh]
        parts = []
        for c in range(classes):
            chain = b.class_chain(c)
            pi = keyset.class_pi[b.key, c]
            entry, leave = entry_exit(b, pi, pre[:, c], suf[:, c])
            _, filt, scale, ll = chain.forward(b.start(chain, pi, entry))
            beta = chain.backward(scale, leave)
            gamma = chain.gamma(filt, beta)
            xi = chain.xi(filt, beta, entry, starts)
            xi[starts] = 0.0
            s, p = gamma[:, :1] * on_c, gamma[:, 1:2] * on_p
            parts += [by_piece(b, ll), gamma[b.rg.starts] * b.fresh[:, None], by_piece(b, xi)]
            parts += [by_piece(b, s), by_piece(b, s * b.pick("cos_s")[:, None])]
            parts += [by_piece(b, p), by_piece(b, p * b.pick("cos_p")[:, None])]
        flat = np.concatenate(parts, axis=1)
        if whole:
            return _emit(weigh(b, flat), np.bincount(b.key, minlength=n_keys) > 0)
        at = pa.array(b.piece)
        arrays = [b.column(k).take(at) for k in keys] + [pa.array(b.key), pa.array(b.rg.lens.astype(float))]
        arrays += [pa.array(np.ascontiguousarray(flat[:, i])) for i in range(flat.shape[1])]
        return [*keys, "fit_key", "n", *cols], arrays

    shapes = {"ll": (), "n": (), "rc": (classes,), "cpi": (classes, 3), "cA": (classes, 3, 3), **_level_shapes(model)}
    n_keys, width = len(model.keys), len(stats) + 1

    def weigh(b: Batch, flat):
        """Class posterior of every (whole) sequence and its weighted sums per key."""
        by_class = flat.reshape(len(flat), classes, width)
        logs = np.log(np.maximum(keyset.rho[b.key], 1e-300)) + by_class[:, :, 0]
        top = logs.max(axis=1, keepdims=True)
        norm = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
        tau = np.exp(logs - norm[:, None])
        weighted = tau[:, :, None] * by_class[:, :, 1:]
        parts = [norm[:, None], b.rg.lens[:, None].astype(float), tau, weighted[:, :, :3], weighted[:, :, 3:12], weighted[:, :, 12:].sum(axis=1)]
        return np.concatenate([_by_key(b, n_keys, p.reshape(len(p), -1), True) for p in parts], axis=1)

    whole = not packed.long
    if whole:
        return _sum_slots(packed, keyset, fn, shapes, (), fold, classes)
    types = {f.name: f.dataType.simpleString() for f in packed.df.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in packed.keys) + ", fit_key bigint, n double, "
    parts = run_kernel(packed, keyset, fn, schema + ", ".join(f"{c} double" for c in cols), fold=fold, classes=classes)
    per_seq = parts.groupBy(*packed.keys, "fit_key").agg(*[F.sum(c).alias(c) for c in ["n", *cols]])
    weighed = _weigh_classes(per_seq, model, classes, stats)
    shapes = {"ll": (), "n": (), "rc": (classes,), **_level_shapes(model)}
    shapes |= {f"c{c}_pi": (3,) for c in range(classes)} | {f"c{c}_A": (3, 3) for c in range(classes)}
    sums = collect_sums(weighed, len(model.keys), shapes)
    sums["cpi"] = np.stack([sums.pop(f"c{c}_pi") for c in range(classes)], axis=1)
    sums["cA"] = np.stack([sums.pop(f"c{c}_A") for c in range(classes)], axis=1)
    return sums


def fit_hybrid(packed: Packed, model: Model, stop: Stop, fold: str | None = None, exact: bool = True) -> list[Fit]:
    """Block classes that each have their own chain; emissions are shared."""

    def update(m: Model, sums: dict) -> Model:
        ks, kp = _kappas(m, sums, exact)
        extra = {
            **m.extra,
            "rho": _simplex(sums["rc"], 1e-6),
            "class_pi": _simplex(sums["cpi"], 1e-6),
            "class_A": _simplex(sums["cA"], 1e-6),
        }
        return replace(m, kappa_s=ks, kappa_p=kp, extra=extra)

    return run_em(model, lambda m: hybrid_step(packed, m, fold), update, stop)


# ------------------------------------------------------------------------------------------------
# stage-wise likelihoods


def em_diagnostics(
    packed: Packed, model: Model, iterations: int, fold: str | None = None, exact: bool = True, smoothing: float = 1e-6,
    drop: float = 1e-7,
) -> list[dict]:
    """LL after each part of the M-step, the first part that lowers it, and whether the kappas were kept.

    The E-step pass and one pass that scores the three candidates of all keys make up an iteration.
    """
    rows: list[dict] = []
    k = len(model.keys)
    for it in range(1, iterations + 1):
        sums = chain_step(packed, model, fold)
        ks, kp = _kappas(model, sums, exact)
        after_a = replace(model, extra={**model.extra, "A": _simplex(sums["A"], smoothing)})
        after_pi = replace(after_a, extra={**after_a.extra, "pi": _simplex(sums["pi"], smoothing)})
        after_k = replace(after_pi, kappa_s=ks, kappa_p=kp)
        stages = [after_a, after_pi, after_k]
        stacked = Model(
            [key for m in stages for key in m.keys],
            model.coh,
            model.prior,
            np.concatenate([m.kappa_s for m in stages]),
            np.concatenate([m.kappa_p for m in stages]),
            {n: np.concatenate([m.extra[n] for m in stages]) for n in model.extra},
        )
        scored = sequence_ll(packed, stacked.keyset(), fold=fold).groupBy("fit_key").agg(F.sum("ll").alias("ll"))
        ll = collect_sums(scored, 3 * k, {"ll": ()})["ll"].reshape(3, k)
        before = sums["ll"]
        kept = ll[2] >= ll[1] - drop if exact else np.ones(k, dtype=bool)
        for j in range(k):
            first = next(
                (n for n, hi, lo in (("transition", before, ll[0]), ("pi", ll[0], ll[1]), ("kappa", ll[1], ll[2])) if lo[j] < hi[j] - drop),
                "none",
            )
            rows.append(
                {
                    "fit_key": j,
                    "iteration": it,
                    "ll_before": float(before[j]),
                    "ll_after_transition": float(ll[0][j]),
                    "ll_after_pi": float(ll[1][j]),
                    "ll_after_kappa": float(ll[2][j] if kept[j] else ll[1][j]),
                    "kappa_candidate_ll": float(ll[2][j]),
                    "first_decreasing_step": first,
                    "kappa_update_accepted": bool(kept[j]),
                }
            )
        model = replace(
            after_k, kappa_s=np.where(kept[:, None], ks, model.kappa_s), kappa_p=np.where(kept[:, None], kp, model.kappa_p)
        )
    return rows


# ------------------------------------------------------------------------------------------------
# fits as tables


def fits_table(df: DataFrame, fits: list[Fit], names: list[str]) -> DataFrame:
    """One row per fit: key fields, likelihood, iterations, parameters as columns."""
    rows, cols = [], None
    for fit in fits:
        p = fit.params
        row = {n: fit.key.get(n) for n in names}
        row |= {
            "n_trials": fit.n_rows,
            "train_ll": fit.train_ll,
            "n_iter": len(fit.history),
            "converged": fit.converged,
        }
        row |= {f"weight_{s}": float(w) for s, w in zip(STATES, p.weights)}
        row |= {f"pi_{s}": float(w) for s, w in zip(STATES, p.pi)}
        if len(p.A):
            row |= {t: float(v) for t, v in zip(TRANSITIONS, np.ravel(p.A))}
        row |= {f"kappa_s_{c:g}".replace("0.", ""): float(v) for c, v in p.kappa_s.items()}
        row |= {f"kappa_p_{w:g}": float(v) for w, v in p.kappa_p.items()}
        cols = list(row)
        rows.append(tuple(row.values()))
    return values_table(df.sparkSession, cols, rows)


def history_table(df: DataFrame, fits: list[Fit], names: list[str]) -> DataFrame:
    rows = [
        (*[f.key.get(n) for n in names], i + 1, ll) for f in fits for i, ll in enumerate(f.history)
    ]
    return values_table(df.sparkSession, [*names, "iteration", "log_likelihood"], rows)

