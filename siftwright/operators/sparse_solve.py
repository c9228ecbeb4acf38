"""Least squares on matrices that are mostly zeros: conjugate gradients instead of a dense inverse.

The matrix comes as the products that occur. Its widest category is a diagonal block and is eliminated exactly (each of its levels
becomes a mean); the rest is solved by conjugate gradients, which need products with the matrix only. Memory is a few
times the number of products, whatever the number of columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Relative size of what may be left over, and of a direction that the matrix maps to nothing.
LEFT, NULL = 1e-14, 1e-10
#: Products handled at once when several right sides are solved side by side.
AT_ONCE = 1 << 24


class Rows:
    """A sparse matrix by rows."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int):
        order = np.argsort(row, kind="stable")
        row, self.col, self.value, self.n = row[order], col[order], value[order], n
        self.head = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        self.at = row[self.head]

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, x.shape[1]))
        step = max(1, AT_ONCE // max(1, len(self.col)))
        for c in range(0, x.shape[1] if len(self.col) else 0, step):
            out[self.at, c:c + step] = np.add.reduceat(self.value[:, None] * x[self.col, c:c + step], self.head, axis=0)
        return out


class Reduced:
    """Generalised inverse of a symmetric positive matrix over (1, X) of which some columns are diagonal among themselves."""

    def __init__(self, i, j, s, keep: np.ndarray, block: np.ndarray, scale: np.ndarray):
        """Triplets i <= j of which columns `keep` stay; `block` marks the diagonal ones; all are divided by `scale`."""
        self.size, self.inside, self.outside = len(keep), np.flatnonzero(keep & block), np.flatnonzero(keep & ~block)
        at = np.full(len(keep), -1)
        at[self.inside], at[self.outside] = np.arange(len(self.inside)), np.arange(len(self.outside))
        s = s / (scale[i] * scale[j])
        live = keep[i] & keep[j]
        i, j, s = i[live], j[live], s[live]
        bi, bj = block[i], block[j]
        own, cross, rest = bi & bj, bi != bj, ~bi & ~bj
        self.d = np.zeros(len(self.inside))
        self.d[at[i[own]]] = s[own]
        inner, outer = np.where(bi, at[i], at[j])[cross], np.where(bi, at[j], at[i])[cross]
        self.edge, self.back = Rows(inner, outer, s[cross], len(self.inside)), Rows(outer, inner, s[cross], len(self.outside))
        a, b, v = at[i[rest]], at[j[rest]], s[rest]
        off = a != b
        self.core = Rows(np.concatenate([a, b[off]]), np.concatenate([b, a[off]]), np.concatenate([v, v[off]]), len(self.outside))
        diagonal = np.zeros(len(self.outside))
        diagonal[a[~off]] = v[~off]
        self.root = np.sqrt(diagonal)
        self.zero = self._null_space()
        self.null = np.zeros((self.size, self.zero.shape[1]))
        self.null[self.outside] = self.zero / self.root[:, None]
        self.null[self.inside] = -self._means(self.null[self.outside])

    def _means(self, x: np.ndarray) -> np.ndarray:
        return (self.edge @ x) / self.d[:, None]

    def _times(self, x: np.ndarray) -> np.ndarray:
        x = x / self.root[:, None]
        return (self.core @ x - self.back @ self._means(x)) / self.root[:, None]

    def _descend(self, right: np.ndarray) -> np.ndarray:
        """Conjugate gradients for all right sides side by side; each must lie in the range of the matrix, and rests once it is solved: further steps would only add up rounding."""
        x, r = np.zeros_like(right), right.copy()
        p, left = r.copy(), (r * r).sum(0)
        goal, least, idle = left * LEFT**2, left.sum(), 0
        while (left > goal).any() and idle < 200:
            q = self._times(p)
            along = (p * q).sum(0)
            step = np.divide(left, along, out=np.zeros_like(left), where=(along > 0) & (left > goal))
            x += step * p
            r -= step * q
            now = (r * r).sum(0)
            p = r + np.divide(now, left, out=np.zeros_like(now), where=left > 0) * p
            left = now
            least, idle = (now.sum(), 0) if now.sum() < 0.99 * least else (least, idle + 1)
        return x

    def _null_space(self) -> np.ndarray:
        """Orthonormal directions that the reduced matrix maps to 0: what random vectors lose when they are mapped and solved back."""
        rng, n, probes = np.random.default_rng(11), len(self.outside), 8
        while n:
            z = rng.choice([-1.0, 1.0], (n, min(probes, n))) if probes < n else np.eye(n)
            lost = z - self._descend(self._times(z))
            u, size, _ = np.linalg.svd(lost, full_matrices=False)
            u = u[:, size > (0.05 * np.sqrt(probes) if probes < n else 0.5)]
            u = u[:, (u * self._times(u)).sum(0) < NULL * n] if u.shape[1] else u
            if 2 * u.shape[1] <= probes or probes >= n:
                return u
            probes *= 4
        return np.zeros((0, 0))

    def solve(self, right: np.ndarray) -> np.ndarray:
        """A solution for each column of `right`, which must lie in the range of the matrix."""
        out, own = np.zeros(right.shape), right[self.inside] / self.d[:, None]
        b = (right[self.outside] - self.back @ own) / self.root[:, None]
        b = b - self.zero @ (self.zero.T @ b)
        x = self._descend(b)
        out[self.outside] = (x - self.zero @ (self.zero.T @ x)) / self.root[:, None]
        out[self.inside] = own - self._means(out[self.outside])
        return out


def least_p(b: np.ndarray, wanted: np.ndarray, low: np.ndarray, spread: Callable, p_of: Callable, noise: float) -> tuple[int, float]:
    """(column, p) of the least p among the wanted columns, the first of equals.

    t^2 is b^2 / (noise * spread). `spread(columns)` costs a solution each, so columns are taken by the bound that `low` <= spread
    puts on t^2, until no other can be ahead. All p of 0 are equal: then the first column in order that reaches 0 is it.
    """
    idx = np.flatnonzero(wanted)
    if not noise > 0 or np.isnan(p_of(1.0)):
        return int(idx[0]), float(p_of(np.inf))
    with np.errstate(divide="ignore"):
        top = np.where(low[idx] > 0, b[idx] ** 2 / (noise * np.maximum(low[idx], 1e-300)), np.inf)
    exact: dict[int, float] = {}

    def look(columns: np.ndarray) -> None:
        new = [c for c in columns.tolist() if c not in exact]
        if new:
            size = noise * spread(np.array(new))
            exact.update(zip(new, np.divide(b[new] ** 2, size, out=np.full(len(new), np.inf), where=size > 0).tolist()))

    near, far = 0.0, 1.0
    while p_of(far) > 0 and far < 1e300:
        near, far = far, far * 2
    if p_of(far) == 0:
        while far - near > 1e-9 * far:
            middle = (near + far) / 2
            near, far = (near, middle) if p_of(middle) == 0 else (middle, far)
        maybe = idx[top >= far * (1 - 1e-9)]
        for at in range(0, len(maybe), 8):
            look(maybe[at:at + 8])
            for c in maybe[at:at + 8].tolist():
                if p_of(exact[c]) == 0:
                    return c, 0.0
    order = np.argsort(-top, kind="stable")
    for at in range(0, len(order), 8):
        if exact and top[order[at]] < max(exact.values()) * (1 - 1e-12):
            break
        look(idx[order[at:at + 8]])
    best = min(sorted(exact), key=lambda c: p_of(exact[c]))
    return best, float(p_of(exact[best]))
