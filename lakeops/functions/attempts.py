"""The login attempt rule on sorted arrays of one user's attempts.

State is ``(count, until)``: failures so far, and the instant a lock ends or ``NEVER``. An attempt
before ``until`` is blocked and changes nothing. A success clears the state. A failure after
``until`` starts anew, and the failure that reaches the maximum locks; one exactly at ``until``
locks again.
"""

from __future__ import annotations

import numpy as np

NEVER = -(2**62)
FRESH = (0, NEVER)


def fold(times, successes, state, max_attempts: int, lockout: int):
    """Outcome, count and lock end after each attempt, and the state after the last one."""
    count, until = state
    outcomes, counts, untils = [], [], []
    for t, success in zip(times, successes):
        if t < until:
            outcome = "blocked"
        elif success:
            outcome, count, until = "success", 0, NEVER
        else:
            if until != NEVER and t > until:
                count, until = 0, NEVER
            count += 1
            outcome = "failed"
            if count >= max_attempts:
                outcome, until = "locked", t + lockout
        outcomes.append(outcome)
        counts.append(count)
        untils.append(until)
    return outcomes, counts, untils, (count, until)


class Exits:
    """Where a stretch of attempts leads for every state it may be entered in.

    The state after a stretch follows from the first attempt that is not blocked. From there the
    path runs over two kinds of points: *fresh* before attempt ``i`` and *locked by* attempt
    ``k``. Every point leads to one later point, so following all of them at once by doubling
    gives the end of every path.
    """

    def __init__(self, times, successes, max_attempts: int, lockout: int):
        self.t = np.asarray(times, dtype=np.int64)
        self.n = n = len(self.t)
        self.max_attempts, self.lockout = max_attempts, lockout
        success = np.asarray(successes, dtype=bool)
        self.failed = ~success
        self.failures = np.flatnonzero(self.failed)
        self.failures_before = np.concatenate(([0], np.cumsum(self.failed)))
        later = np.where(success, np.arange(n), n)
        self.next_success = np.append(np.minimum.accumulate(later[::-1])[::-1], n)

        # Points 0..n are fresh, n+1.. are locks, and the last point is "the stretch has ended".
        self.end = 2 * n + 1
        fresh = self._after_fresh(np.arange(n + 1), 0)
        step = np.concatenate((fresh, self._after_lock(), [self.end]))
        exit_count = np.zeros(2 * n + 2, dtype=np.int64)
        exit_until = np.full(2 * n + 2, NEVER, dtype=np.int64)
        ends = np.flatnonzero(step[: n + 1] == self.end)
        exit_count[ends] = self.failures_before[n] - self.failures_before[ends]
        exit_count[n + 1 : self.end] = max_attempts
        exit_until[n + 1 : self.end] = self.t + lockout

        # A lock that follows a lock at the very instant it ends counts one failure more; any other
        # step starts the count anew. ``gain`` adds these up to the end of the path.
        here = np.arange(2 * n + 2)
        point = np.where(step == self.end, here, step)
        is_lock = (here > n) & (here < self.end)
        relocks = is_lock & (point > n) & (point < self.end) & (point != here)
        gain = relocks.astype(np.int64)
        anew = (point != here) & ~relocks
        while True:
            gain = np.where(anew[point], gain[point], gain + gain[point])
            anew = anew | anew[point]
            further = point[point]
            if np.array_equal(further, point):
                break
            point = further
        gain = np.where(is_lock[point], gain, 0)
        self.count, self.until = exit_count[point] + gain, exit_until[point]
        # Only relocks up to the end: the count goes on from the one the path is entered with.
        self.goes_on = np.where(is_lock & ~anew, 1 + gain, 0)

    def _after_fresh(self, i, count):
        """The point after being fresh before attempt ``i`` with ``count`` failures so far."""
        n = self.n
        success = self.next_success[i]
        nth = self.failures_before[i] + (self.max_attempts - 1 - count)
        padded = np.append(self.failures, n)
        lock = padded[np.minimum(nth, len(self.failures))]
        return np.where(
            (success < n) & (success < lock),
            success + 1,
            np.where(lock < n, n + 1 + lock, self.end),
        )

    def _entry(self, until):
        """The point reached from locks that end at ``until``."""
        j = np.searchsorted(self.t, until, side="left")
        inside = np.minimum(j, self.n - 1)
        again = (j < self.n) & (self.t[inside] == until) & self.failed[inside]
        return np.where(j == self.n, self.end, np.where(again, self.n + 1 + inside, j))

    def _after_lock(self):
        return self._entry(self.t + self.lockout)

    def from_count(self, count: int):
        """State after the stretch when it is entered unlocked with ``count`` failures."""
        point = int(self._after_fresh(np.array([0]), count)[0])
        if point == self.end:
            return count + int(self.failures_before[self.n]), NEVER
        return int(self.count[point]), int(self.until[point])

    def from_locks(self):
        """``(at, count, until, count_at, until_at)`` in order of ``at``.

        A lock that ends before ``at``, but after the line before it, leads to ``(count, until)``;
        one that ends exactly at ``at`` to ``(count_at, until_at)``. A lock past the last line stays.
        Only locks that end within one lockout of the first attempt can come from before it.
        """
        at = np.unique(self.t)
        reach = np.searchsorted(at, self.t[0] + self.lockout, side="right") + 1
        at = at[:reach]
        fresh = np.searchsorted(self.t, at, side="left")
        exact = self._entry(at)
        # A negative count is what to add to the count the stretch is entered with.
        count_at = np.where(self.goes_on[exact] > 0, -self.goes_on[exact], self.count[exact])
        lines = (at, self.count[fresh], self.until[fresh], count_at, self.until[exact])
        # A line that leads where the next one leads adds nothing.
        needed = np.ones(len(at), dtype=bool)
        needed[:-1] = False
        for before, exactly in ((lines[1], lines[3]), (lines[2], lines[4])):
            needed |= before != exactly
            needed[:-1] |= before[:-1] != before[1:]
        return tuple(column[needed] for column in lines)


def enter(state, at, count, until, count_at, until_at):
    """The state after a stretch entered with a lock, from the lines of ``from_locks``."""
    j = int(np.searchsorted(at, state[1], side="left"))
    if j == len(at):
        return state
    if at[j] == state[1]:
        ahead = int(count_at[j])
        return (state[0] - ahead if ahead < 0 else ahead), int(until_at[j])
    return int(count[j]), int(until[j])
