"""Hidden chains as products of small matrices, and linear recurrences, with short loops.

A series of steps is cut into blocks of about the square root of its length; within all blocks at
once, and over all members of a batch at once, the steps' k x k matrices are multiplied up, and the
blocks are joined by their totals; large batches are stepped time after time. States stand first:
weights are (k, members, times), steps (k, k, members, times), the step from a time's states (first
axis) to those of the next.
"""

from __future__ import annotations

import math

import numpy as np

LEAST = 1e-300
MANY = 500  # numbers per step from which on a loop over times is faster


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix products along the first two axes."""
    out = a[:, 0, None] * b[None, 0]
    for j in range(1, len(b)):
        out += a[:, j, None] * b[None, j]
    return out


def _block(now: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Row vectors (k, ...) times products (..., k, k, ...), which stand before as many axes as a vector's parts have."""
    at = whole.ndim - now.ndim - 1
    out = now[0] * whole.take(0, at)
    for j in range(1, len(now)):
        out += now[j] * whole.take(j, at)
    return out


def _one_by_one(first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same time after time: for batches so large that the k-fold work of the products costs more than a loop."""
    k, _, r, t = steps.shape
    ordered, rows, size = np.ascontiguousarray(np.moveaxis(steps, 3, 0)), np.empty((t + 1, k, r)), np.empty((t + 1, r))
    size[0] = np.maximum(first.sum(0), LEAST)
    rows[0] = now = first / size[0]
    for i in range(t):
        now = (now[:, None] * ordered[i]).sum(0)
        size[i + 1] = now.sum(0)
        now = now / np.maximum(size[i + 1], LEAST)
        rows[i + 1] = now
    return np.moveaxis(rows, 0, 2), np.cumsum(np.log(np.maximum(size, LEAST)), 0).T


def forward(first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From weights ``first`` (k, r) of the first time: causal probabilities (k, r, t + 1), and the log of all weight up to each time (r, t + 1)."""
    k, _, r, t = steps.shape
    return _one_by_one(first, steps) if k * k * r > MANY else _in_blocks(first, steps)


def _in_blocks(first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, _, r, t = steps.shape
    wide = max(1, math.isqrt(t))
    blocks = -(-t // wide)
    whole = np.zeros((k, k, r, blocks * wide))
    whole[..., :t] = steps
    whole[..., t:] = np.eye(k)[:, :, None, None]
    whole = np.ascontiguousarray(np.moveaxis(whole.reshape(k, k, r, blocks, wide), 4, 0))
    log = np.empty((wide, r, blocks))
    for i in range(wide):  # products within all blocks
        if i:
            whole[i] = _times(whole[i - 1], whole[i])
        np.maximum(whole[i].reshape(k * k, r, blocks).sum(0), LEAST, out=log[i])
        whole[i] /= log[i]
    log = np.cumsum(np.log(log, out=log), 0)
    size = np.maximum(first.sum(0), LEAST)
    begin, so_far = np.empty((blocks + 1, k, r)), np.empty((blocks + 1, r))
    begin[0], so_far[0] = first / size, np.log(size)
    for b, total in enumerate(np.ascontiguousarray(np.moveaxis(whole[-1], 3, 0))):  # from block to block, by their totals alone
        now = _block(begin[b], total)
        size = np.maximum(now.sum(0), LEAST)
        begin[b + 1], so_far[b + 1] = now / size, so_far[b] + log[-1, :, b] + np.log(size)
    rows = _block(np.ascontiguousarray(np.moveaxis(begin[:-1], 0, 2)), whole)  # all times of all blocks at once
    size = np.maximum(rows.sum(1), LEAST)
    rows /= size[:, None]
    told = so_far[:-1].T + log + np.log(size)
    rows = np.moveaxis(rows, 0, 3).reshape(k, r, -1)[..., :t]
    told = np.moveaxis(told, 0, 2).reshape(r, -1)[..., :t]
    return np.concatenate([np.moveaxis(begin[:1], 0, 2), rows], 2), np.concatenate([so_far[:1].T, told], 1)


def backward(steps: np.ndarray) -> np.ndarray:
    """What each state of each time makes of the steps after it, up to a factor per time: (k, r, t + 1)."""
    k, _, r, _ = steps.shape
    turned, _ = forward(np.ones((k, r)), np.swapaxes(steps[..., ::-1], 0, 1))
    return turned[..., ::-1]


def both(first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What :func:`forward` and :func:`backward` give, in one pass over twice the members."""
    k, _, r, _ = steps.shape
    if k * k * r > MANY:
        return *forward(first, steps), backward(steps)
    rows, log = _in_blocks(np.concatenate([first, np.ones((k, r))], 1), np.concatenate([steps, np.swapaxes(steps[..., ::-1], 0, 1)], 2))
    return rows[:, :r], log[:r], rows[:, r:, ::-1]


def smoothed(alpha: np.ndarray, beta: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two-sided probabilities (k, r, t + 1) of the states and (k, k, r, t) of each step's pairs of states."""
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(0), LEAST)
    pairs = alpha[:, None, :, :-1] * steps * beta[None, :, :, 1:]
    pairs /= np.maximum(pairs.sum((0, 1)), LEAST)
    return gamma, pairs


def recurrence(inputs: np.ndarray, factor: float) -> np.ndarray:
    """y[t] = factor * y[t-1] + inputs[t] with y[-1] = 0, by doubling the reach of the sum (inputs along the last axis)."""
    y, reach = np.array(inputs, float), 1
    while reach < y.shape[-1] and factor:
        new = y.copy()
        new[..., reach:] += factor * y[..., :-reach]
        y, reach, factor = new, 2 * reach, factor * factor
    return y
