"""Forward-backward over linear chains: many sequences at once, long ones cut without changing the result.

Values are laid out by state and in the order of steps, so that a step of all sequences is one contiguous slice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Sequences are cut into parts of so many steps, which then go side by side.
SEGMENT = 256


@dataclass
class Chains:
    """What a pass found: the log of each sequence's total weight (where the transitions of each state sum to one) and, if asked
    for, the distribution over states of each place, in the order `source` of places, and the expected transitions."""

    likelihood: np.ndarray
    source: np.ndarray
    states: np.ndarray | None = None
    pairs: np.ndarray | None = None


def segments(lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sequences cut into parts of SEGMENT: begin, length, sequence and number of each, and where each sequence's start."""
    parts = -(-lengths // SEGMENT)
    first = np.cumsum(parts) - parts
    of = np.repeat(np.arange(len(lengths)), parts)
    number = np.arange(parts.sum()) - first[of]
    begin = (np.cumsum(lengths) - lengths)[of] + number * SEGMENT
    return begin, np.minimum(lengths[of] - number * SEGMENT, SEGMENT), of, number, first


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=0)


def _carry(weights: np.ndarray, ids: np.ndarray, start: np.ndarray, transition: np.ndarray, begin: np.ndarray, size: np.ndarray, parts: np.ndarray, first: np.ndarray, place: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
    """Fills in what long sequences bring over their cuts: `before` [state, part] is the prior of a part's first place,
    `after` the weight of all that follows its last one.

    The matrices of each part are multiplied, for all parts side by side; the products then carry the distribution from part
    to part. That is the recursion over the whole sequence, in another order of the same products.
    """
    docs = np.flatnonzero(parts > 1)
    many = np.flatnonzero(np.repeat(parts > 1, parts))
    many = np.sort(place[many])  # still longest first
    live = np.searchsorted(-size[many], -np.arange(int(size[many[0]])), "left")
    heads = np.zeros(len(begin), bool)
    heads[place[first[docs]]] = True
    k, turned = len(start), np.ascontiguousarray(transition.T)
    # product[j, i, part]: from state i before a part to state j at its last place; a sequence's first part has no step into it
    product = np.where(heads[many], np.eye(k)[:, :, None], turned[:, :, None]) * weights[:, None, ids[begin[many]]]
    for s, n in enumerate(live[1:], 1):
        x = (turned @ product[:, :, :n].reshape(k, -1)).reshape(k, k, n)
        x *= weights[:, None, ids[begin[many[:n]] + s]]
        if s % 8 == 0:
            x /= x.max(axis=(0, 1))
        product[:, :, :n] = x
    product /= product.max(axis=(0, 1))
    at = np.empty(len(begin), np.int64)
    at[many] = np.arange(len(many))
    last = np.repeat(start[:, None].astype(np.float64), len(docs), axis=1)
    for j in range(int(parts.max()) - 1):
        more = parts[docs] > j + 1
        docs, last = docs[more], last[:, more]
        last = _scaled(np.einsum("in,jin->jn", last, product[:, :, at[place[first[docs] + j]]]))
        before[:, place[first[docs] + j + 1]] = _scaled(turned @ last)
    docs = np.flatnonzero(parts > 1)
    for j in range(int(parts.max()) - 2, -1, -1):
        on = docs[parts[docs] > j + 1]
        there = place[first[on] + j + 1]
        after[:, place[first[on] + j]] = _scaled(np.einsum("jin,jn->in", product[:, :, at[there]], after[:, there]))


def forward_backward(weights: np.ndarray, ids: np.ndarray, lengths: np.ndarray, start: np.ndarray, transition: np.ndarray, smooth: bool) -> Chains:
    """One pass over sequences of symbols that follow each other in `ids`, each of `lengths` symbols, one at least.

    The weight of a labelling is start[y0] w[y0, x0] t[y0, y1] w[y1, x1] .., with w the `weights` [state, symbol]; none of
    the values need be normalised. With `smooth`, places get their distribution over states, too.
    """
    k = len(start)
    if not len(lengths):
        return Chains(np.zeros(0), np.zeros(0, np.int64), np.zeros((k, 0)), np.zeros((k, k)))
    begin, size, of, number, first = segments(lengths)
    order = np.argsort(-size, kind="stable")
    begin, size, of, number = begin[order], size[order], of[order], number[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    parts = -(-lengths // SEGMENT)
    before, after = np.repeat(start[:, None].astype(np.float64), len(order), axis=1), np.ones((k, len(order)))
    if parts.max() > 1:
        _carry(weights, ids, start, transition, begin, size, parts, first, place, before, after)
    active = np.searchsorted(-size, -np.arange(int(size[0])), "left")
    ends = np.cumsum(active)
    starts = ends - active
    rank = np.arange(ends[-1]) - np.repeat(starts, active)
    source = begin[rank] + np.repeat(np.arange(len(active)), active)
    e = np.take(weights, ids[source], axis=1)
    scale, turned = np.empty(len(source)), np.ascontiguousarray(transition.T)
    forward = np.empty_like(e) if smooth else None
    prior = before
    for lo, hi in zip(starts, ends, strict=True):
        a = prior[:, : hi - lo] * e[:, lo:hi]
        total = a.sum(axis=0)
        a /= total
        scale[lo:hi] = total
        if smooth:
            forward[:, lo:hi] = a
        prior = turned @ a
    found = Chains(np.bincount(of[rank], np.log(scale), minlength=len(lengths)), source)
    if smooth:
        cut = np.flatnonzero(number + 1 < parts[of])  # parts with one after them
        ahead = forward[:, starts[size[cut] - 1] + cut]
        pairs, n, x = np.zeros((k, k)), 0, after[:, :0]
        for lo, hi in zip(starts[::-1], ends[::-1], strict=True):
            beta = after[:, : hi - lo].copy()
            beta[:, :n] = transition @ x
            a = forward[:, lo:hi]
            both = a * beta
            mass = both.sum(axis=0)
            if n:
                pairs += (a[:, :n] / mass[:n]) @ x.T
            np.divide(both, mass, out=a)  # forward turns into the distribution
            x, n = e[:, lo:hi] * beta, hi - lo
            x /= x.sum(axis=0)
        x = x[:, place[first[of[cut]] + number[cut] + 1]]
        pairs += (ahead / (ahead * (transition @ x)).sum(axis=0)) @ x.T
        found.states, found.pairs = forward, transition * pairs
    return found
