"""Fits whose keys and parameters are a Spark table.

A table of fits has one row per fit: `by` (columns that its data share, such as the subject), `labels` (what tells the fits of
the same data apart, such as the left-out fold or the starting point), `folds` (the folds it is trained on; null: all rows) and
its parameters as flat arrays. An iteration is one job: packed sequences meet the fits of their `by` key in a join, a kernel
sums over each piece, the sums are added by fit, and the M-step runs where these sums are. The new table is written, which
cuts the lineage; the driver only learns how many fits still move. So the number of keys is bounded by nothing but the
cluster, and a job with twenty thousand subjects has the plan of a job with twelve.

A sequence meets the list of its fits (as many as labels, whatever the table's size) and is not copied for each. Spark picks
the join by the size of the written table; a subject with a third of all rows is split as a skewed partition. Of a table of at
most `SMALL` bytes the list holds numbers only: the parameters go to the tasks once, and a task adds the sums of its pieces by
fit. Only sequences of several pieces meet what crosses their borders, or their other pieces, in a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from arcseq.columns import STATES, TRANSITIONS
from arcseq.functions.bessel import kappa_approx, kappa_exact
from arcseq.operators.em import Stop
from arcseq.operators.kernels import segment_sum, softmax_rows
from arcseq.operators.params import Params
from arcseq.operators.recursions import Batch, ListKeys, Packed, entry_exit, in_parts, read_borders, run_kernel
from arcseq.session import stage

CLASSES = 3
#: Bytes of parameters up to which a table of fits is broadcast; larger ones meet their data in a shuffle.
SMALL = 8 << 20
PARTS = {
    "subject_iid": ["weights"],
    "prior_conditioned_iid": ["condition_weights"],
    "exchangeable_block_mixture": ["rho", "class_weights"],
    "hmm": ["pi", "A"],
    "block_plus_markov": ["rho", "class_pi", "class_A"],
}


@dataclass
class Model:
    """One of the models of PARTS with its levels; `shapes` of all parameters by name."""

    name: str
    coh: list[float]
    prior: list[float]

    @property
    def shapes(self) -> dict[str, tuple]:
        known = {
            "weights": (3,), "condition_weights": (len(self.prior), 3), "rho": (CLASSES,), "class_weights": (CLASSES, 3), "pi": (3,), "A": (3, 3),
            "class_pi": (CLASSES, 3), "class_A": (CLASSES, 3, 3), "kappa_s": (len(self.coh),), "kappa_p": (len(self.prior),),
        }
        return {n: known[n] for n in [*PARTS[self.name], "kappa_s", "kappa_p"]}

    @property
    def sums(self) -> dict[str, tuple]:
        """Sums of an E-step by name."""
        levels = {"sw": (len(self.coh),), "sc": (len(self.coh),), "pw": (len(self.prior),), "pc": (len(self.prior),)}
        own = {
            "subject_iid": {"g": (3,)}, "prior_conditioned_iid": {"g": (len(self.prior), 3)}, "hmm": {"pi": (3,), "A": (3, 3)},
            "exchangeable_block_mixture": {"rc": (CLASSES,), "cw": (CLASSES, 3)}, "block_plus_markov": {"rc": (CLASSES,), "cpi": (CLASSES, 3), "cA": (CLASSES, 3, 3)},
        }[self.name]
        return {"ll": (), "n": (), **own, **levels}

    @property
    def classes(self) -> int:
        return CLASSES if "rho" in self.shapes else 0

    def values(self, p: Params) -> dict[str, np.ndarray]:
        out = {"kappa_s": [p.kappa_s[c] for c in self.coh], "kappa_p": [p.kappa_p[w] for w in self.prior]}
        if "condition_weights" in self.shapes:
            out["condition_weights"] = [p.condition_weights.get(w, p.weights) for w in self.prior]
        return {n: np.asarray(out.get(n) if n in out else getattr(p, n), dtype=float).reshape(shape) for n, shape in self.shapes.items()}


def _size(shape: tuple) -> int:
    return int(np.prod(shape)) if shape else 1


def _literal(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in np.ravel(values)])


def starts(keys: DataFrame, model: Model, inits: list[Params], label: str = "seed") -> DataFrame:
    """A fit for each row of `keys` and starting point; with several points their number is the column `label`."""
    out = keys
    if len(inits) > 1:
        out = out.withColumn(label, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(inits) - 1).cast("long"))))
    given = [model.values(p) for p in inits]
    at = F.col(label).cast("int") if len(inits) > 1 else F.lit(0)
    return out.withColumns({n: F.array(*[_literal(v[n]) for v in given])[at] for n in model.shapes})


def fold_fits(keys: DataFrame, train: list[list[int]], labels: list[int], label: str = "fold") -> DataFrame:
    """Every row of `keys` once for each training set: `folds`, and the name of what it leaves out."""
    sets = F.array(*[F.struct(F.lit(name).cast("long").alias(label), F.array(*[F.lit(f) for f in own]).alias("folds")) for own, name in zip(train, labels, strict=True)])
    return keys.withColumn("__set", F.explode(sets)).select(*keys.columns, f"__set.{label}", "__set.folds")


def _labels(fits: DataFrame, by: list[str], model: Model) -> list[str]:
    return [c for c in fits.columns if c not in {*by, *model.shapes, "folds", "history", "n_trials", "converged"}]


class _Lists:
    """Stands for a key set: each batch brings the fits of its rows."""

    def __init__(self, model: Model, labels: list[str], fan: int):
        self.model, self.labels, self.fan = model, labels, fan

    def fan_out(self) -> int:
        return self.fan

    def keys(self, kind: type, fits: dict, n: int) -> tuple[ListKeys, dict]:
        p = {k: fits[k].flatten().to_numpy(zero_copy_only=False).reshape(n, *shape) for k, shape in self.model.shapes.items()}
        found = kind(
            names=list(range(n)), pi=p.get("pi", np.full((n, 3), 1 / 3)), A=p.get("A", np.full((n, 3, 3), 1 / 3)), kappa_s=p["kappa_s"], kappa_p=p["kappa_p"],
            subject=[], folds=[], rho=p.get("rho"), class_pi=p.get("class_pi"), class_A=p.get("class_A"),
        )
        return found.prepare(), p

    def batch(self, raw: pa.RecordBatch, x_cols: tuple = (), fold: str | None = None) -> Batch:
        lists = raw.column(raw.schema.get_field_index("fits"))
        flat = dict(zip([f.name for f in lists.type.value_type], lists.flatten().flatten(), strict=True))
        keys, p = self.keys(ListKeys, flat, len(lists.flatten()))
        keys.counts = np.diff(lists.offsets.to_numpy())
        b = Batch(raw, keys, x_cols)
        b.params, b.labels = p, [flat[c] for c in self.labels]
        return b


class _NumberedKeys(ListKeys):
    """As ListKeys, the rows naming their parameter sets by number."""

    numbers: np.ndarray

    def members(self, subjects, folds):
        return np.repeat(np.arange(len(self.counts)), self.counts), self.numbers


class _Numbered(_Lists):
    """Fits of a small table, which the tasks hold; each row brings the numbers of its own."""

    def __init__(self, model: Model, labels: list[str], fan: int, fits: pa.Table):
        super().__init__(model, labels, fan)
        self.fits = {c: fits.column(c).combine_chunks() for c in [*labels, *model.shapes]}
        self.n = fits.num_rows

    def batch(self, raw: pa.RecordBatch, x_cols: tuple = (), fold: str | None = None) -> Batch:
        lists = raw.column(raw.schema.get_field_index("fits"))
        keys, p = self.keys(_NumberedKeys, self.fits, self.n)
        keys.counts, keys.numbers = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
        b = Batch(raw, keys, x_cols)
        at = pa.array(b.key)
        b.params, b.labels = p, [self.fits[c].take(at) for c in self.labels]
        return b


def matched(packed: Packed, fits: DataFrame, by: list[str], model: Model, labels: list[str], fold: str | None, fan: int, small: bool = False) -> tuple[Packed, _Lists]:
    """Packed sequences with the list of the fits that they belong to, and what reads it; `small` says that all fits together are
    known to be."""
    folds = ["folds"] if fold else []
    if small:
        table = fits.select(*by, *labels, *folds, *model.shapes).toArrow()  # at most SMALL bytes
        lists = _Numbered(model, labels, fan, table)
        numbered = table.select([*by, *folds]).append_column("number", pa.array(np.arange(table.num_rows, dtype=np.int32)))
        kinds = ", ".join(f"`{c}` {dict(fits.dtypes)[c]}" for c in [*by, *folds])
        fits = fits.sparkSession.createDataFrame(numbered.to_pylist(), ", ".join([*([kinds] if kinds else []), "number int"]))
        item = F.struct("number", *folds)
    else:
        lists = _Lists(model, labels, fan)
        item = F.struct(*labels, *folds, *model.shapes)
    own = fits.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("fits"))
    data = packed.df
    if by:
        own = own.withColumnsRenamed({c: f"__{c}" for c in by})
        own = F.broadcast(own) if small else own
        data = data.join(own, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]).drop(*[f"__{c}" for c in by])
    else:
        data = data.withColumn("__one", F.when(F.col("first_pos").isNotNull(), 1)).join(F.broadcast(own.withColumn("__one", F.lit(1))), "__one").drop("__one")
    if fold:
        mine = lambda f: f["folds"].isNull() | F.array_contains(f["folds"], F.col(fold).cast("int"))
        data = data.withColumn("fits", F.filter("fits", mine))
    if small:
        data = data.withColumn("fits", F.col("fits.number"))
    return Packed(data.filter(F.size("fits") > 0), packed.coh, packed.prior, packed.long, packed.keys), lists


# ------------------------------------------------------------------------------------------------
# kernels: sums of each piece under each of its fits


def _by_piece(b: Batch, values: np.ndarray) -> np.ndarray:
    return segment_sum(values.reshape(b.rg.n, -1), b.rg)


def _levels(b: Batch, model: Model, gamma: np.ndarray) -> list[np.ndarray]:
    s = gamma[:, :1] * (b.pick("ci")[:, None] == np.arange(len(model.coh)))
    p = gamma[:, 1:2] * (b.pick("pi_")[:, None] == np.arange(len(model.prior)))
    return [_by_piece(b, x) for x in (s, s * b.pick("cos_s")[:, None], p, p * b.pick("cos_p")[:, None])]


def _mixed(log_w: np.ndarray, log_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log density and responsibilities of a mixture, by row."""
    logs = np.log(np.maximum(log_w, 1e-300)) + log_b
    top = logs.max(axis=1, keepdims=True)
    return top[:, 0] + np.log(np.exp(logs - top).sum(axis=1)), softmax_rows(logs)


def _mixture_sums(b: Batch, model: Model) -> np.ndarray:
    conditioned = model.name == "prior_conditioned_iid"
    w = b.params["condition_weights"][b.row_key, b.pick("pi_")] if conditioned else b.params["weights"][b.row_key]
    ll, gamma = _mixed(w, b.log_b())
    g = (gamma[:, None, :] * (b.pick("pi_")[:, None] == np.arange(len(model.prior)))[:, :, None]) if conditioned else gamma
    return np.concatenate([_by_piece(b, ll), b.rg.lens[:, None].astype(float), _by_piece(b, g), *_levels(b, model, gamma)], axis=1)


def _chain(b: Batch, model: Model, chain, pi, pre, suf) -> np.ndarray:
    """ll, first state, transitions and level sums of each piece."""
    entry, leave = entry_exit(b, pi, pre, suf)
    _, filt, scale, ll = chain.forward(b.start(chain, pi, entry))
    beta = chain.backward(scale, leave)
    gamma = chain.gamma(filt, beta)
    heads = b.rg.starts[b.fresh]
    xi = chain.xi(filt, beta, entry, heads)
    xi[heads] = 0.0
    return np.concatenate([_by_piece(b, ll), gamma[b.rg.starts] * b.fresh[:, None], _by_piece(b, xi), *_levels(b, model, gamma)], axis=1)


def _chain_sums(b: Batch, model: Model) -> np.ndarray:
    pre, suf, _ = read_borders(b)
    found = _chain(b, model, b.chain(), b.keyset.pi[b.key], pre, suf)
    return np.concatenate([found[:, :1], b.rg.lens[:, None].astype(float), found[:, 1:]], axis=1)


def _class_sums(b: Batch, model: Model) -> np.ndarray:
    """piece x class x (ll, sums of the class, level sums)."""
    out = []
    if model.name == "block_plus_markov":
        pre, suf, _ = read_borders(b, CLASSES)
        pre, suf = pre.reshape(-1, CLASSES, 3, 3), suf.reshape(-1, CLASSES, 3, 3)
        for c in range(CLASSES):
            out.append(_chain(b, model, b.class_chain(c), b.keyset.class_pi[b.key, c], pre[:, c], suf[:, c]))
    else:
        log_b = b.log_b()
        for c in range(CLASSES):
            ll, gamma = _mixed(b.params["class_weights"][b.row_key, c], log_b)
            out.append(np.concatenate([_by_piece(b, ll), _by_piece(b, gamma), *_levels(b, model, gamma)], axis=1))
    return np.stack(out, axis=1)


def _weigh(by_class: np.ndarray, rho: np.ndarray, n: np.ndarray, own: int) -> np.ndarray:
    """Sums of whole sequences weighted by their class posteriors; `own` sums of each class come before those all share."""
    logs = np.log(np.maximum(rho, 1e-300)) + by_class[:, :, 0]
    top = logs.max(axis=1, keepdims=True)
    ll = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
    tau = np.exp(logs - ll[:, None])
    weighted = tau[:, :, None] * by_class[:, :, 1:]
    if own == 12:  # first states of all classes, then transitions
        each = [weighted[:, :, :3].reshape(len(tau), -1), weighted[:, :, 3:12].reshape(len(tau), -1)]
    else:
        each = [weighted[:, :, :own].reshape(len(tau), -1)]
    return np.concatenate([ll[:, None], n[:, None], tau, *each, weighted[:, :, own:].sum(axis=1)], axis=1)


def _types(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{c}` {kinds[c]}, " for c in names)


def e_step(packed: Packed, fits: DataFrame, by: list[str], model: Model, fold: str | None, fan: int, small: bool = False, per_sequence: bool = False) -> DataFrame:
    """Sums of `model.sums` (columns s0, s1, ...) of parts of the data of every fit, or of every fit and sequence."""
    labels = _labels(fits, by, model)
    rows, lists = matched(packed, fits, by, model, labels, fold, fan, small)
    seq = list(packed.keys)
    keys = seq if per_sequence else by
    width = sum(map(_size, model.sums.values()))
    cut = bool(model.classes) and packed.long
    own = 12 if model.name == "block_plus_markov" else 3
    kernel = {"hmm": _chain_sums, "subject_iid": _mixture_sums, "prior_conditioned_iid": _mixture_sums}.get(model.name, _class_sums)
    heads = list(dict.fromkeys([*(seq if cut else []), *by, *keys]))

    def fn(b: Batch):
        found = kernel(b, model)
        extra = []
        if cut:
            extra = [b.rg.lens.astype(float)[:, None], b.params["rho"][b.key]]
            found = found.reshape(len(found), -1)
        elif model.classes:
            found = _weigh(found, b.params["rho"][b.key], b.rg.lens.astype(float), own)
        flat = np.concatenate([found, *extra], axis=1)
        each = np.arange(len(flat))
        if not (cut or per_sequence):
            order = np.argsort(b.key, kind="stable")
            firsts = np.flatnonzero(np.diff(b.key[order], prepend=-1))
            flat, each = np.add.reduceat(flat[order], firsts, axis=0), order[firsts]
        at = pa.array(b.piece[each])
        arrays = [b.column(k).take(at) for k in heads] + [x.take(pa.array(each)) for x in b.labels] + [pa.array(np.ascontiguousarray(flat[:, i])) for i in range(flat.shape[1])]
        return [*heads, *labels, *(f"s{i}" for i in range(flat.shape[1]))], arrays

    per_class = 1 + own + 2 * (len(model.coh) + len(model.prior))
    columns = CLASSES * per_class + 1 + CLASSES if cut else width
    schema = _types(rows.df, heads) + _types(fits, labels) + ", ".join(f"s{i} double" for i in range(columns))
    borders = {"classes": CLASSES} if model.name == "block_plus_markov" else {}
    source = rows if model.name in ("hmm", "block_plus_markov") else Packed(rows.df, rows.coh, rows.prior, False, rows.keys)
    out = run_kernel(source, lists, fn, schema, **borders)
    if cut:
        # whole sequences first: the class posterior needs all their pieces
        aggs = [F.sum(f"s{i}").alias(f"s{i}") for i in range(CLASSES * per_class + 1)] + [F.first(f"s{i}").alias(f"s{i}") for i in range(CLASSES * per_class + 1, columns)]
        whole = out.groupBy(*heads, *labels).agg(*aggs)
        passed = list(dict.fromkeys([*keys, *by]))

        def weigh(batches):
            for raw in batches:
                if raw.num_rows:
                    at = {f.name: i for i, f in enumerate(raw.schema)}
                    flat = np.stack([raw.column(at[f"s{i}"]).to_numpy() for i in range(columns)], axis=1)
                    found = _weigh(flat[:, : CLASSES * per_class].reshape(-1, CLASSES, per_class), flat[:, -CLASSES:], flat[:, CLASSES * per_class], own)
                    arrays = [raw.column(at[c]) for c in [*passed, *labels]] + [pa.array(np.ascontiguousarray(found[:, i])) for i in range(width)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*passed, *labels, *(f"s{i}" for i in range(width))])

        out = whole.mapInArrow(weigh, _types(rows.df, passed) + _types(fits, labels) + ", ".join(f"s{i} double" for i in range(width)))
    return out


# ------------------------------------------------------------------------------------------------
# the loop


def _simplex(x: np.ndarray, add: float) -> np.ndarray:
    x = x + add
    return x / x.sum(axis=-1, keepdims=True)


def updated(model: Model, s: dict[str, np.ndarray], exact: bool, smoothing: float) -> dict[str, np.ndarray]:
    """M-step of many fits at once."""
    kappa, floor = (kappa_exact, 1e-15) if exact else (kappa_approx, 1e-300)
    out = {"kappa_s": kappa(s["sc"] / np.maximum(s["sw"], floor)), "kappa_p": kappa(s["pc"] / np.maximum(s["pw"], floor))}
    for name, total in {"weights": "g", "condition_weights": "g", "pi": "pi", "A": "A"}.items():
        if name in model.shapes:
            out[name] = _simplex(s[total], smoothing)
    for name, total in {"rho": "rc", "class_weights": "cw", "class_pi": "cpi", "class_A": "cA"}.items():
        if name in model.shapes:
            out[name] = _simplex(s[total], 1e-6)
    return out


def _lists_of(a: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(a, dtype=float).reshape(len(a), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)), pa.array(flat.ravel()))


def _extent(fits: DataFrame, by: list[str], model: Model) -> tuple[int, bool]:
    """Fits of the same data at most, and whether all fits together are small."""
    found = fits.groupBy(*by).count().agg(F.max("count"), F.sum("count")).first()
    bytes_each = 8 * sum(map(_size, model.shapes.values())) + 200
    return found[0] or 1, (found[1] or 0) * bytes_each <= SMALL


def fit(packed: Packed, fits: DataFrame, by: list[str], model: Model, stop: Stop, fold: str | None = None, exact: bool = True, smoothing: float = 1e-6) -> DataFrame:
    """`fits` (see `starts`) after EM: their parameters, history (likelihoods), n_trials and converged.

    Stops as `em.run_em` does: by `stop.tol` for each fit alone, or after `stop.max_iter` updates. Fits without any rows stay
    at their starting point with an empty history.
    """
    labels = _labels(fits, by, model)
    names = list(model.shapes)
    pieces = in_parts(packed)
    if "folds" not in fits.columns:
        fits = fits.withColumn("folds", F.lit(None).cast("array<int>"))
    state = stage(
        fits.select(*by, *labels, "folds", *names, F.array().cast("array<double>").alias("history"), F.lit(0).cast("long").alias("n_trials"), F.lit(False).alias("converged")), "fits"
    )
    fan, small = _extent(state, by, model)
    shapes, sums = model.shapes, model.sums
    width = sum(map(_size, sums.values()))
    keys = [*by, *labels]
    for it in range(stop.max_iter):
        last = stop.rule == "absolute" and stop.tol is not None and it + 1 == stop.max_iter

        def m_step(batches, it=it, last=last):
            for raw in batches:
                if not raw.num_rows:
                    continue
                col = {f.name: raw.column(i) for i, f in enumerate(raw.schema)}
                flat = np.stack([col[f"s{i}"].to_numpy(zero_copy_only=False) for i in range(width)], axis=1)
                s, at = {}, 0
                for n, shape in sums.items():
                    s[n] = flat[:, at : at + _size(shape)].reshape(len(flat), *shape)
                    at += _size(shape)
                old = {n: col[n].flatten().to_numpy(zero_copy_only=False).reshape(len(flat), *shape) for n, shape in shapes.items()}
                before = col["history"].to_pylist()
                ll = s["ll"]
                gain = np.array([x - h[-1] if h else np.inf for x, h in zip(ll, before, strict=True)])
                top = np.array([max(1.0, abs(h[-1])) if h else 1.0 for h in before])
                if stop.tol is None:
                    done = np.zeros(len(ll), bool)
                elif stop.rule == "absolute":
                    done = np.abs(gain) < stop.tol
                else:
                    done = (it >= stop.min_iter) & (gain >= -1e-5) & (gain / top < stop.tol)
                seen = np.isfinite(ll)
                held = ~seen | (done if stop.rule == "absolute" else False) | last
                new = updated(model, {n: np.where(np.isfinite(v), v, 1.0) for n, v in s.items()}, exact, smoothing)
                for n in new:
                    new[n] = np.where(held.reshape(-1, *[1] * (new[n].ndim - 1)), old[n], new[n])
                history = [[*h, float(x)] if ok else h for h, x, ok in zip(before, ll, seen, strict=True)]
                cells = [col[c] for c in [*keys, "folds"]] + [_lists_of(new[n]) for n in names]
                cells += [pa.array(history, pa.list_(pa.float64())), pa.array(np.where(seen, s["n"], 0).astype(np.int64)), pa.array(done | ~seen)]
                yield pa.RecordBatch.from_arrays(cells, names=[*keys, "folds", *names, "history", "n_trials", "converged"])

        active = state.filter(~F.col("converged"))
        each = [e_step(part, active.drop("history", "n_trials", "converged"), by, model, fold, fan, small) for part in pieces]
        found = reduce(DataFrame.unionByName, each)
        # fits and their sums meet in one shuffle; a fit without sums has no rows
        kept = ["folds", *names, "history"]
        parts = active.select(*keys, *kept).unionByName(found.select(*keys, *[f"s{i}" for i in range(width)]), allowMissingColumns=True)
        met = parts.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in kept], *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema)
        moved = met.mapInArrow(m_step, schema)
        watch = Observation()
        result = moved.observe(watch, F.sum((~F.col("converged")).cast("long")).alias("moving"))
        if it:
            result = result.unionByName(state.filter("converged"))
        state = stage(result, "fits")
        if stop.tol is not None and not watch.get["moving"]:
            break
    return state


def score(packed: Packed, fits: DataFrame, by: list[str], model: Model, fold: str | None = None) -> DataFrame:
    """ll and n of every sequence under every fit whose `folds` hold its fold."""
    labels = _labels(fits, by, model)
    fan, small = _extent(fits, by, model)
    own = fits.select(*by, *labels, *(["folds"] if fold else []), *model.shapes)
    out = reduce(DataFrame.unionByName, [e_step(part, own, by, model, fold, fan, small, per_sequence=True) for part in in_parts(packed)])
    keys = [*dict.fromkeys([*packed.keys, *by]), *labels]
    return out.groupBy(*keys).agg(F.sum("s0").alias("ll"), F.sum("s1").cast("long").alias("n"))


# ------------------------------------------------------------------------------------------------
# fits as tables


def best_of(fits: DataFrame, keys: list[str], label: str = "seed") -> DataFrame:
    """The fit with the highest likelihood of each key; ties go to the smaller `label`."""
    order = F.struct(F.element_at("history", -1).alias("ll"), (-F.col(label)).alias("first"))
    whole = F.struct(*fits.columns)
    return fits.filter(F.size("history") > 0).groupBy(*keys).agg(F.max_by(whole, order).alias("x")).select("x.*")


def table(fits: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """Key fields, n_trials, train_ll, n_iter, converged, and each parameter as a column."""
    cols = [*keys, "n_trials", F.try_element_at("history", F.lit(-1)).alias("train_ll"), F.size("history").cast("long").alias("n_iter"), "converged"]
    names = {"weights": [f"weight_{s}" for s in STATES], "pi": [f"pi_{s}" for s in STATES], "A": TRANSITIONS}
    names["rho"] = [f"rho_{c}" for c in range(CLASSES)]
    names["class_weights"] = [f"cw_{c}{s}" for c in range(CLASSES) for s in range(3)]
    names["condition_weights"] = [f"w_{w:g}_{s}" for w in model.prior for s in STATES]
    names["class_pi"] = [f"class_pi_{c}{s}" for c in range(CLASSES) for s in range(3)]
    names["class_A"] = [f"class_A_{c}{i}{j}" for c in range(CLASSES) for i in range(3) for j in range(3)]
    names["kappa_s"] = [f"kappa_s_{c:g}".replace("0.", "") for c in model.coh]
    names["kappa_p"] = [f"kappa_p_{w:g}" for w in model.prior]
    return fits.select(*cols, *[F.col(n)[i].alias(c) for n in model.shapes for i, c in enumerate(names[n])])


def history(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Likelihood of every iteration."""
    return fits.select(*keys, F.posexplode("history").alias("at", "log_likelihood")).select(*keys, (F.col("at") + 1).cast("long").alias("iteration"), "log_likelihood")
