"""Cheapest edits of role sequences, and the least audit among the cheapest: array work on
the rows of many conversations at a time.

States are what the repaired sequence ends with: nothing, ``s``, ``u`` or ``a``.  A node is
a state before one of the rows (or behind the last).  From a node, Delete goes on to the
same state before the next row; Keep and Rerole to the state of the kept or new role;
Insert to the state of the inserted role before the same row.  Each letter leads to one
node, so an audit is a path of letters.

First the cost to go of every node, backwards (long conversations by blocks of rows whose
cost matrices are multiplied, so the steps taken one after another are few).  Then prefix
doubling over the optimal arcs: nodes are ranked by the first letter of their least audit,
by its first two, four, eight, ...: the rank for twice the length comes from a node's own
rank and that of the node its doubled pointer reaches.  Equal final ranks are equal audits;
each different one is read once through the doubled pointers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
NEVER = 1 << 50
BLOCK = 64

START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state after a new user or assistant, which follows from the state before.
NEXT = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])
#: The state after a kept row, by its initial (s, u, a, other) and the state before; -1: none.
KEPT = np.array([[AFTER_S, -1, -1, -1], [AFTER_U, AFTER_U, -1, AFTER_U], [-1, -1, AFTER_A, -1], [-1] * 4])
#: An audit may end without cost at the start or after an assistant.
ACCEPT = np.array([0, NEVER, NEVER, 0])
LETTERS = b"\0DIKR"  # by code, in the order of their bytes
D, I, K, R = range(1, 5)


@dataclass
class Rows:
    """Rows of conversations, one after another.  ``bounds`` has one entry more than there
    are conversations.  ``tail``: how many further copies, all to be deleted, follow a row."""
    initial: np.ndarray
    must_go: np.ndarray
    truncated: np.ndarray
    tail: np.ndarray
    bounds: np.ndarray

    @property
    def conversation(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def copies(self, n: int) -> Rows:
        """The rows of one conversation as ``n`` conversations."""
        size = len(self.initial)
        return Rows(*(np.tile(x, n) for x in (self.initial, self.must_go, self.truncated, self.tail)), np.arange(n + 1) * size)


def with_inserts(cost: np.ndarray) -> np.ndarray:
    """The states' costs when up to two rows may be inserted first."""
    return np.minimum(np.minimum(cost, cost[:, NEXT] + INSERT), cost[:, NEXT[NEXT]] + 2 * INSERT)


def before(rows: Rows, at: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Costs before rows ``at`` from the costs behind them (rows, states, columns)."""
    late = np.where(rows.truncated[at], TRUNCATED, 0)
    gone = np.where(rows.must_go[at], NEVER, 0)
    target = KEPT[rows.initial[at]]
    kept = np.take_along_axis(cost, np.maximum(target, 0)[:, :, None], 1)
    best = np.minimum(cost + DELETE, cost[:, NEXT] + (REROLE + late + gone)[:, None, None])
    best = np.minimum(best, kept + (KEEP + (late + gone)[:, None] + np.where(target < 0, NEVER, 0))[:, :, None])
    return with_inserts(best + DELETE * rows.tail[at][:, None, None])


def costs_to_go(rows: Rows, ends: np.ndarray) -> np.ndarray:
    """Cost to go of all nodes, (layer, state).  Row r of conversation c is layer r + c;
    behind its last row comes one more layer, with the costs ``ends`` of the conversation."""
    n = np.diff(rows.bounds)
    blocks = -(-n // BLOCK)
    owner = np.repeat(np.arange(len(n)), blocks)
    starts = np.cumsum(blocks) - blocks
    number = np.arange(len(owner)) - starts[owner]
    first = rows.bounds[:-1][owner] + number * BLOCK
    size = np.minimum(BLOCK, rows.bounds[1:][owner] - first)
    behind = ends[owner].astype(np.int64)
    if len(owner) and blocks.max() > 1:
        many = np.flatnonzero(blocks[owner] > 1)
        matrix = np.zeros((len(owner), 4, 4), np.int64)
        some = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, NEVER), (len(many), 4, 4)).copy()
        for t in range(int(size[many].max())):
            on = np.flatnonzero(size[many] > t)
            some[on] = before(rows, (first + size - 1 - t)[many[on]], some[on])
        matrix[many] = some
        for j in range(int(blocks.max()) - 1, 0, -1):
            at = starts[blocks > j] + j
            behind[at - 1] = np.minimum((matrix[at] + behind[at][:, None, :]).min(2), NEVER)
    out = np.empty((len(rows.initial) + len(n), 4), np.int64)
    out[rows.bounds[1:] + np.arange(len(n))] = ends
    cost = behind[:, :, None]
    for t in range(int(size.max()) if len(size) else 0):
        on = np.flatnonzero(size > t)
        at = first[on] + size[on] - 1 - t
        cost[on] = before(rows, at, cost[on])
        out[at + owner[on]] = cost[on, :, 0]
    return np.minimum(out, NEVER)


def matrix_of(rows: Rows) -> np.ndarray:
    """Least cost from each state before one piece of a conversation to each behind it."""
    ends = np.where(np.eye(4, dtype=bool), 0, NEVER)
    return costs_to_go(rows.copies(4), ends)[np.arange(4) * (len(rows.initial) + 1)].T


def least_arcs(rows: Rows, cost: np.ndarray, final: bool) -> tuple[np.ndarray, np.ndarray]:
    """Code of the least letter among the optimal arcs of every node (0: none), and the
    node that arc leads to (nodes: layer * 4 + state)."""
    layers, state = len(cost), np.arange(4)
    code = np.zeros((layers, 4), np.int8)
    target = np.arange(layers * 4).reshape(-1, 4)
    open_ = cost < NEVER

    def allow(where, letter, price, layer, to):
        """``letter`` is optimal at layers ``where`` if it costs no more than what is known."""
        hit = open_[where] & (price + np.take_along_axis(cost[layer], np.maximum(to, 0), 1) == cost[where]) & (to >= 0)
        code[where] = np.where(hit, letter, code[where])
        target[where] = np.where(hit, layer[:, None] * 4 + to, target[where])

    at = np.arange(len(rows.initial)) + rows.conversation
    late = np.where(rows.truncated, TRUNCATED, 0) + np.where(rows.must_go, NEVER, 0)
    tail = (DELETE * rows.tail)[:, None]
    new = np.broadcast_to(NEXT, (len(at), 4))
    # From the last letter to the first: what is set last is least.
    allow(at, R, REROLE + late[:, None] + tail, at + 1, new)
    allow(at, K, KEEP + late[:, None] + tail, at + 1, KEPT[rows.initial])
    allow(at, I, INSERT, at, new)
    allow(at, D, DELETE + tail, at + 1, np.broadcast_to(state, (len(at), 4)))
    if final:
        last = rows.bounds[1:] + np.arange(len(rows.bounds) - 1)
        allow(last, I, INSERT, last, np.broadcast_to(NEXT, (len(last), 4)))
    return code.ravel(), target.ravel()


def least_audits(rows: Rows, cost: np.ndarray, entry: np.ndarray, final: bool) -> tuple[list[str], np.ndarray]:
    """The letters of each conversation's least cheapest audit from state ``entry`` on
    (without the deletions of further copies), and the state it ends in."""
    code, pointer = least_arcs(rows, cost, final)
    rank, doubled = code.astype(np.int64), [pointer]
    while code[doubled[-1]].any():
        pointer = doubled[-1]
        rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1]
        doubled.append(pointer[pointer])
    begin = (rows.bounds[:-1] + np.arange(len(rows.bounds) - 1)) * 4 + entry
    _, one, same = np.unique(rank[begin], return_index=True, return_inverse=True)
    path = begin[one][:, None]
    for pointer in doubled:
        path = np.concatenate([path, pointer[path]], axis=1)
    letters = np.frombuffer(LETTERS, np.uint8)[code[path]]
    audits = [row.tobytes().rstrip(b"\0").decode("ascii") for row in letters]
    return [audits[i] for i in same], doubled[-1][begin] % 4


def final_costs(n: int) -> np.ndarray:
    """Costs behind the last rows of ``n`` conversations."""
    return np.repeat(with_inserts(ACCEPT[None, :]), n, axis=0)
