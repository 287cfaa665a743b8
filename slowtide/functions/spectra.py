"""Small dense eigenproblems of one series: on its d × d matrices, or on its rows while they are fewer than d."""

from dataclasses import dataclass

import numpy as np

#: Variance, as a share of the largest, up to which a direction counts as rounding: beyond the rank.
RANK = 1e-12


def eigen_descending(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (largest first, not below 0) and eigenvectors as rows."""
    values, vectors = np.linalg.eigh(c)
    return np.clip(values[::-1], 0.0, None), vectors.T[::-1]


def fix_signs(rows: np.ndarray) -> np.ndarray:
    """Flip each row so that its entry of largest magnitude is positive."""
    if rows.size == 0:
        return rows
    # entries equal up to rounding count as equal: the first of them decides
    size = np.abs(rows)
    lead = (size >= size.max(axis=1, keepdims=True) * (1 - 1e-9)).argmax(axis=1)
    signs = np.sign(rows[np.arange(len(rows)), lead])
    return rows * np.where(signs == 0, 1.0, signs)[:, None]


def rank_of(variances: np.ndarray) -> int:
    """How many of the descending variances are more than rounding; none if nothing varies."""
    return int((variances > RANK * variances[0]).sum()) if len(variances) else 0


def retained_count(variances: np.ndarray, keep: float | int | None, n: int) -> int:
    """Number of principal components to keep.

    An integer is a count, a fraction in (0, 1) the share of variance to
    exceed, None everything. At most n, and nothing beyond the rank: a single row, or
    equal rows, keep none.
    """
    limit = min(rank_of(variances), n)
    if keep is None:
        return limit
    if isinstance(keep, float) and 0 < keep < 1:
        total = variances.sum()
        if total <= 0:
            return 0
        shares = np.cumsum(variances / total)
        return min(int(np.searchsorted(shares, keep, side="right")) + 1, limit)
    return min(int(keep), limit)


@dataclass(frozen=True)
class Factors:
    """What the fits of one series need: variances (descending) along orthonormal axes (rows).

    ``steps`` is the covariance of the differences in these axes. There are d axes,
    or r < d where the series spans r directions only; all variance lies in them.
    """

    n: int
    mean: np.ndarray
    variances: np.ndarray
    axes: np.ndarray
    steps: np.ndarray

    @classmethod
    def of_matrices(cls, n: int, mean: np.ndarray, c: np.ndarray, d: np.ndarray) -> "Factors":
        variances, axes = eigen_descending(c)
        return cls(n, mean, variances, axes, axes @ d @ axes.T)

    @classmethod
    def of_rows(cls, x: np.ndarray, dx: np.ndarray) -> "Factors":
        """From the n rows themselves and their differences: no d × d matrix, a thin decomposition of n × d."""
        n, mean = len(x), x.mean(axis=0)
        _, sizes, axes = np.linalg.svd(x - mean, full_matrices=False)
        variances = sizes**2 / max(n - 1, 1)
        r = rank_of(variances)
        along = dx @ axes[:r].T
        along = along - along.mean(axis=0) if len(along) else along
        return cls(n, mean, variances[:r], axes[:r], along.T @ along / max(len(along) - 1, 1))

    @property
    def spectrum(self) -> np.ndarray:
        """All d variances."""
        return np.r_[self.variances, np.zeros(len(self.mean) - len(self.variances))]

    def slow_directions(
        self, keep: float | int | None = None, cutoff: float = 1e-15, cutoff_mode: str = "absolute"
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Deltas ascending, weights k × d, whitening r × d; see ``slow_directions``."""
        r = retained_count(self.variances, keep, self.n)
        floor = cutoff * (self.variances.sum() if cutoff_mode == "ratio" else 1.0)
        kept = np.flatnonzero(self.variances[:r] > floor)
        size = 1 / np.sqrt(self.variances[kept])
        whitening = self.axes[kept] * size[:, None]
        turned = self.steps[np.ix_(kept, kept)] * np.outer(size, size)
        deltas, turns = np.linalg.eigh((turned + turned.T) / 2) if len(kept) else (np.zeros(0), np.zeros((0, 0)))
        return np.clip(deltas, 0.0, None), fix_signs(turns.T @ whitening), fix_signs(whitening)


def slow_directions(
    c: np.ndarray,
    d: np.ndarray,
    n: int,
    keep: float | int | None = None,
    cutoff: float = 1e-15,
    cutoff_mode: str = "absolute",
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slow directions of a series with covariance ``c`` and difference covariance ``d``.

    Returns (deltas ascending, weights k × d, whitening r × d, variances d).
    ``keep`` first restricts the series to its leading principal components.
    Directions with variance up to ``cutoff`` (or that share of the total, with
    mode ``ratio``) are trivial and dropped; so are those beyond the rank.
    """
    factors = Factors.of_matrices(n, np.zeros(len(c)), c, d)
    return *factors.slow_directions(keep, cutoff, cutoff_mode), factors.spectrum


def slowest(c: np.ndarray, d: np.ndarray, n: int, keep: float, cutoff: float = 1e-15) -> np.ndarray:
    """Smallest slowness value of each pair in two stacks of matrices; nan where nothing changes.

    The same as the first value of ``slow_directions``, for many small matrices at once.
    """
    size = c.shape[-1]
    variances, axes = np.linalg.eigh(c)
    variances = np.clip(variances[:, ::-1], 0.0, None)
    axes = np.swapaxes(axes, 1, 2)[:, ::-1]
    total = variances.sum(axis=1, keepdims=True)
    shares = np.cumsum(variances / np.where(total > 0, total, 1.0), axis=1)
    retained = np.minimum((shares <= keep).sum(axis=1) + 1, min(size, n))
    floor = np.maximum(cutoff, variances[:, :1] * RANK)
    # only the directions that some pair retains go on
    kept = (np.arange(size) < retained[:, None]) & (variances > floor)
    most = int(kept.sum(axis=1).max(initial=0))
    kept, axes = kept[:, :most], axes[:, :most]
    whitening = axes * np.where(kept, 1 / np.sqrt(np.where(kept, variances[:, :most], 1.0)), 0.0)[:, :, None]
    spread = whitening @ d @ np.swapaxes(whitening, 1, 2)
    # dropped directions stand apart from the kept ones; move them behind all others
    spread[:, np.arange(most), np.arange(most)] += np.where(kept, 0.0, 1e9)
    if not most:
        return np.full(len(c), np.nan)
    found = np.clip(np.linalg.eigvalsh(spread)[:, 0], 0.0, None)
    return np.where(kept.any(axis=1), found, np.nan)
