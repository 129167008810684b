"""Chain recursions over many ragged pieces at once (NumPy, runs inside tasks).

Rows of all pieces are concatenated; piece s owns rows starts[s] .. starts[s]+lens[s]-1. Each step t
advances every piece longer than t together, so the Python loop is as long as the longest piece.
`trans` holds one matrix per piece (S,3,3) or one per row (N,3,3); a row's matrix leads into that row.
"""

from __future__ import annotations

import numpy as np


class Ragged:
    def __init__(self, lens):
        self.lens = np.asarray(lens, dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)[:-1]]).astype(np.int64) if len(self.lens) else self.lens
        self.n = int(self.lens.sum())
        self.order = np.argsort(-self.lens, kind="stable")
        self.sorted_starts = self.starts[self.order]
        self.sorted_lens = self.lens[self.order]
        self.piece = np.repeat(np.arange(len(self.lens)), self.lens)
        self.heads = self.starts[self.lens > 0]

    def steps(self):
        """Yield (t, rows at offset t, number of active pieces)."""
        longest = int(self.sorted_lens[0]) if len(self.sorted_lens) else 0
        for t in range(longest):
            m = int(np.searchsorted(-self.sorted_lens, -t, side="left"))
            yield t, self.sorted_starts[:m] + t, m


class Chain:
    """Emissions and transitions of a set of pieces."""

    def __init__(self, ragged: Ragged, log_b, trans, per_row: bool = False):
        self.rg = ragged
        self.log_b = log_b
        self.shift = log_b.max(axis=1) if len(log_b) else np.zeros(0)
        self.b = np.exp(log_b - self.shift[:, None])
        self.trans = trans
        self.per_row = per_row
        self.sorted_trans = None if per_row else trans[ragged.order]

    def step_matrix(self, rows, m):
        return self.trans[rows] if self.per_row else self.sorted_trans[:m]

    def row_matrix(self):
        return self.trans if self.per_row else self.trans[self.rg.piece]

    def forward(self, first):
        """`first` is the predictive distribution of each piece's first row."""
        pred = np.empty((self.rg.n, 3))
        filt = np.empty((self.rg.n, 3))
        scale = np.empty(self.rg.n)
        f = None
        start = first[self.rg.order]
        for t, rows, m in self.rg.steps():
            q = start[:m] if t == 0 else np.einsum("si,sij->sj", f[:m], self.step_matrix(rows, m))
            u = q * self.b[rows]
            c = np.maximum(u.sum(axis=1), 1e-300)
            f = u / c[:, None]
            pred[rows], filt[rows], scale[rows] = q, f, c
        return pred, filt, scale, np.log(scale) + self.shift

    def backward(self, scale, last):
        """`last` is the backward vector at each piece's last row."""
        beta = np.empty((self.rg.n, 3))
        ends = self.rg.sorted_starts + self.rg.sorted_lens - 1
        longest = int(self.rg.sorted_lens[0]) if len(self.rg.sorted_lens) else 0
        v = None
        for t in range(longest):
            m = int(np.searchsorted(-self.rg.sorted_lens, -t, side="left"))
            rows = ends[:m] - t
            if t == 0:
                v = last[self.rg.order][:m]
            else:
                nxt = rows + 1
                v = np.einsum("sij,sj->si", self.step_matrix(nxt, m), self.b[nxt] * v[:m]) / scale[nxt][:, None]
            beta[rows] = v
        return beta

    def gamma(self, filt, beta):
        g = filt * beta
        return g / np.maximum(g.sum(axis=1, keepdims=True), 1e-300)

    def around(self, filt, beta, entry):
        """What stands before and after the transition into each row: `before` x matrix x `after` is its pairwise posterior,
        not yet normed. `entry` is the filtered vector before each piece, used where the piece continues a sequence."""
        before = np.empty_like(filt)
        before[1:] = filt[:-1]
        if len(self.rg.heads):
            before[self.rg.heads] = entry[self.rg.lens > 0]
        return before, self.b * beta

    def xi(self, filt, beta, entry, starts_chain):
        """Pairwise posterior stored at the target row; NaN at rows that start a sequence."""
        before, after = self.around(filt, beta, entry)
        out = pairs(before, self.row_matrix(), after)
        out[starts_chain] = np.nan
        return out

    def product(self, starts_seq):
        """Scaled product of the step matrices of each piece; a sequence start has no transition."""
        p = np.repeat(np.eye(3)[None], len(self.rg.lens), axis=0)
        fresh = starts_seq[self.rg.order]
        out = p[self.rg.order]
        for t, rows, m in self.rg.steps():
            step = self.step_matrix(rows, m) * self.b[rows][:, None, :]
            if t == 0:
                step = np.where(fresh[:m, None, None], np.eye(3)[None] * self.b[rows][:, None, :], step)
            prod = out[:m] @ step
            out[:m] = prod / np.maximum(prod.max(axis=(1, 2), keepdims=True), 1e-300)
        p[self.rg.order] = out
        return p

    def max_product(self, starts_seq):
        """Best log path score from the state before each piece to its last state."""
        log_a = np.log(np.maximum(self.trans, 1e-300))
        out = np.where(np.eye(3) > 0, 0.0, -np.inf)[None].repeat(len(self.rg.lens), axis=0)
        fresh = starts_seq[self.rg.order]
        for t, rows, m in self.rg.steps():
            a = log_a[rows] if self.per_row else log_a[self.rg.order][:m]
            if t == 0:
                a = np.where(fresh[:m, None, None], np.where(np.eye(3) > 0, 0.0, -np.inf)[None], a)
            out[:m] = (out[:m, :, :, None] + a[:, None, :, :]).max(axis=2) + self.log_b[rows][:, None, :]
        p = np.empty_like(out)
        p[self.rg.order] = out
        return p

    def viterbi(self, first, ends):
        """Best path; `first` holds log scores before the first emission, `ends` the last states (-1: free)."""
        log_a = np.log(np.maximum(self.trans, 1e-300))
        back = np.zeros((self.rg.n, 3), dtype=np.int8)
        final = np.empty((len(self.rg.lens), 3))
        d = None
        start = first[self.rg.order]
        for t, rows, m in self.rg.steps():
            if t == 0:
                d = start[:m] + self.log_b[rows]
            else:
                a = log_a[rows] if self.per_row else log_a[self.rg.order][:m]
                scores = d[:m, :, None] + a
                back[rows] = scores.argmax(axis=1)
                d = scores.max(axis=1) + self.log_b[rows]
            final[self.rg.order[:m]] = d
        path = np.empty(self.rg.n, dtype=np.int8)
        last_rows = self.rg.sorted_starts + self.rg.sorted_lens - 1
        state = np.where(ends >= 0, ends, final.argmax(axis=1))[self.rg.order].astype(np.int64)
        for t in range(int(self.rg.sorted_lens[0]) if len(self.rg.sorted_lens) else 0):
            m = int(np.searchsorted(-self.rg.sorted_lens, -t, side="left"))
            rows = last_rows[:m] - t
            if t > 0:
                state = back[rows + 1, state[:m]].astype(np.int64)
            path[rows] = state[:m]
        return path


def pairs(before, a, after):
    """Pairwise posteriors of transitions by the matrices `a`."""
    joint = before[:, :, None] * a * after[:, None, :]
    total = joint.sum(axis=(1, 2), keepdims=True)
    return np.where(total > 0, joint / np.where(total > 0, total, 1), a / a.sum(axis=(1, 2), keepdims=True))


def softmax_rows(x):
    z = x - x.max(axis=-1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=-1, keepdims=True)


def segment_sum(values, ragged: Ragged):
    """Sum of rows per piece (pieces are contiguous)."""
    out = np.zeros((len(ragged.lens),) + values.shape[1:])
    if len(ragged.heads):
        out[ragged.lens > 0] = np.add.reduceat(values, ragged.heads, axis=0)
    return out
