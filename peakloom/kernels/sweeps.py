"""Order-dependent steps over sorted rows that come in pieces: what is decided is handed on, so memory is that of the rows in reach.

Each class has ``feed(**arrays)`` and ``finish()``, as ``operators.kernelled.stream_groups`` calls them. Which pairs match does not depend on
what was decided before, so matches are found for many rows at once and only they are gone through one by one.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from decimal import ROUND_HALF_UP, Decimal

import numpy as np

from peakloom.kernels.clusters import CARBON

PAIRS = 500_000  # candidate pairs that are looked at together


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all places low .. high - 1 of each row."""
    n = np.maximum(high - low, 0)
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)


def fitting(n: np.ndarray) -> int:
    """How many of the first rows have at most ``PAIRS`` candidates together, at least one."""
    return max(1, int(np.searchsorted(np.cumsum(n), PAIRS, "right")))


def rows_of(arrays: dict, which) -> dict:
    return {c: v[which] for c, v in arrays.items()}


def joined(pieces: list[dict]) -> dict:
    return pieces[0] if len(pieces) == 1 else {c: np.concatenate([p[c] for p in pieces]) for c in pieces[0]}


class SliceTwins:
    """Ids of the peaks that stay when each slice is compared with the last one that kept any (``ions.slice_redundancy``); rows by (slice, apex)."""

    def __init__(self, tolerance: float, cap: float) -> None:
        self.tolerance, self.cap, self.open, self.before = tolerance, cap, [], None

    def feed(self, **rows) -> dict | None:
        out = []
        slices = np.asarray(rows["slice"], float)
        if np.isnan(slices).any():  # without a slice there is nothing to compare with
            out.append(rows["id"][np.isnan(slices)])
            rows, slices = rows_of(rows, ~np.isnan(slices)), slices[~np.isnan(slices)]
        ends = [*(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(slices)]
        begin = 0
        for end in ends:
            if begin == end:
                continue
            if self.open and self.open[-1]["slice"][-1] != slices[begin]:
                out += self.close()
            self.open.append(rows_of(rows, slice(begin, end)))
            begin = end
        return {"id": np.concatenate(out)} if out else None

    def finish(self) -> dict | None:
        out = self.close() if self.open else []
        out += [self.before["id"]] if self.before is not None else []
        return {"id": np.concatenate(out)} if out else None

    def close(self) -> list[np.ndarray]:
        """Take the slice that is complete; ids of the last one that are settled by it."""
        now, self.open = joined(self.open), []
        old = self.before
        if old is None or not len(old["id"]):
            self.before = now
            return []
        n, begin, alive = len(now["id"]), 0, np.ones(len(now["id"]), bool)
        while begin < n and len(old["id"]):
            some = rows_of(now, slice(begin, begin + 4096))
            i, j, took = self.matches(some, old)
            stays, dead, taller = bytearray(b"\1") * len(old["id"]), -1, (some["height"][i] > old["height"][j]).tolist()
            for a, b, mine in zip(i.tolist(), j.tolist(), taller):
                if a == dead or not stays[b]:
                    continue
                if mine:
                    stays[b] = 0
                else:
                    dead = a
                    alive[begin + a] = False
            old = rows_of(old, np.frombuffer(stays, np.uint8) > 0)
            begin += took
        now = rows_of(now, alive)
        if len(now["id"]):
            self.before = now
            return [old["id"]]
        self.before = old
        return []

    def matches(self, some: dict, old: dict) -> tuple[np.ndarray, np.ndarray, int]:
        """Pairs that are alike, in order, of the first rows of ``some``, and how many those are."""
        with np.errstate(invalid="ignore"):
            sound = np.flatnonzero(np.isfinite(old["apex"]))
            widths = (old["right"] - old["left"])[sound]
            widest = np.max(widths[~np.isnan(widths)], initial=-np.inf)
            half = np.minimum(np.nan_to_num((some["right"] - some["left"] + widest) / 4, nan=self.cap, posinf=self.cap, neginf=0.0), self.cap)
            half = np.where(np.isfinite(some["apex"]), np.maximum(half, 0.0) * (1 + 1e-9) + np.abs(some["apex"]) * 1e-12 + 1e-12, -1.0)
            ranked = old["apex"][sound]
            low, high = np.searchsorted(ranked, some["apex"] - half, "left"), np.searchsorted(ranked, some["apex"] + half, "right")
            high = np.where(half >= 0, high, low)
            took = fitting(high - low)
            i, j = spread(low[:took], high[:took])
            j = sound[j]
            apex_i, apex_j, left_i, left_j = some["apex"][i], old["apex"][j], some["left"][i], old["left"][j]
            reach = np.minimum((some["right"][i] - left_i + old["right"][j] - left_j) / 4, self.cap)
            alike = (np.abs(some["mz"][i] - old["mz"][j]) <= self.tolerance) & np.where(apex_j <= apex_i, left_i < apex_j, left_j < apex_i)
            hit = alike & (np.abs(apex_i - apex_j) <= reach)
        return i[hit], j[hit], took


class Survivors:
    """Ids of the rows that stay when of any two that match, taken by the lighter and then the heavier one, the taller stays; rows by m/z.

    A pair is decided after all pairs that could decide one of its rows before it in that order; taking pairs by the heavier row first keeps all
    of them before it, so only rows in reach that still stay are held.
    """

    BLOCK = 512

    def __init__(self) -> None:
        self.wait, self.size, self.held = [], 0, None

    def feed(self, **rows) -> dict | None:
        sound = np.isfinite(np.asarray(rows["mz"], float))
        out = [] if sound.all() else [rows["id"][~sound]]  # near nothing
        if sound.any():
            self.wait.append(rows if sound.all() else rows_of(rows, sound))
            self.size += int(sound.sum())
        if self.size >= self.BLOCK:
            out += self.settle()
        return {"id": np.concatenate(out)} if out else None

    def finish(self) -> dict | None:
        out = self.settle() if self.wait else []
        if self.held is not None:
            out.append(self.held["id"])
        return {"id": np.concatenate(out)} if out else None

    def settle(self) -> list[np.ndarray]:
        every, out = joined(self.wait), []
        self.wait, self.size = [], 0
        begin, step = 0, self.BLOCK
        while begin < len(every["id"]):
            block = rows_of(every, slice(begin, begin + step))
            old = self.held
            if old is not None:
                near = ~self.beyond(old["mz"], block["mz"][0])
                if not near.all():
                    out.append(old["id"][~near])
                    old = rows_of(old, near)
            both = block if old is None else joined([old, block])
            found = self.matches(both, len(both["id"]) - len(block["id"]), step > 1)
            if found is None:
                self.held, step = old, max(1, step // 2)
                continue
            i, j = found
            keep, taller = bytearray(b"\1") * len(both["id"]), (both["height"][i] >= both["height"][j]).tolist()
            for a, b, light in zip(i.tolist(), j.tolist(), taller):
                if keep[a] and keep[b]:
                    keep[b if light else a] = 0
            self.held = rows_of(both, np.frombuffer(keep, np.uint8) > 0)
            begin += len(block["id"])
        return out

    def pairs(self, both: dict, left: np.ndarray, right: np.ndarray, first: int, bounded: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """(i, j), i before j, of rows whose times ``left`` to ``right`` meet, j from ``first`` on; None if there are too many at once."""
        order = np.argsort(left, kind="stable")
        widths = right - left
        widest = np.max(widths[np.isfinite(widths)], initial=0.0)
        mine = np.arange(first, len(left))
        slack = 1e-9 * (1 + np.abs(left[mine]))
        low = np.searchsorted(left[order], left[mine] - widest - slack, "left")
        high = np.searchsorted(left[order], right[mine] + slack, "right")
        if bounded and np.maximum(high - low, 0).sum() > PAIRS:
            return None
        j, i = spread(low, high)
        i, j = order[i], mine[j]
        return i[i < j], j[i < j]


class MergedRegions(Survivors):
    """As ``ions.merge_regions``: regions within ``share`` of a slice match if their apexes are close or their times mostly coincide."""

    def __init__(self, width: float, share: float = 0.5, cap: float = 0.1, overlap: float = 0.8) -> None:
        super().__init__()
        self.reach, self.cap, self.overlap = width * share, cap, overlap

    def beyond(self, mz, ahead):
        return ahead - mz > self.reach

    def matches(self, both: dict, first: int, bounded: bool):
        with np.errstate(invalid="ignore", divide="ignore"):
            found = self.pairs(both, both["left"], both["right"], first, bounded)
            if found is None:
                return None
            i, j = found
            near = both["mz"][j] - both["mz"][i] <= self.reach
            i, j = i[near], j[near]
            left_i, left_j, right_i, right_j = both["left"][i], both["left"][j], both["right"][i], both["right"][j]
            half = np.minimum((right_i - left_i + right_j - left_j) / 4, self.cap)
            half = np.where(half == 0, self.cap, half)
            shared, narrow = np.minimum(right_i, right_j) - np.maximum(left_i, left_j), np.minimum(right_i - left_i, right_j - left_j)
            cover = np.where(shared <= 0, 0.0, np.where(narrow <= 0, 1.0, shared / narrow))
            hit = (right_i >= left_j) & (right_j >= left_i) & ((np.abs(both["apex"][i] - both["apex"][j]) <= half) | (cover >= self.overlap))
        i, j = i[hit], j[hit]
        order = np.lexsort((i, j))
        return i[order], j[order]


class EnvelopeWalk:
    """(id, mono, step) as ``clusters.isotope_envelopes`` finds them; rows by (m/z, id).

    Rows are kept by cells of time as high as the tolerance, each sorted by m/z, so that a step looks at the few rows near its goal only; a walk
    ends at the first follower that is not accepted, since no later one can be.
    """

    FAR = 8.1

    def __init__(self, base: float = 0.01, rt_tolerance: float = 0.06, charges: int = 4, most: int = 8) -> None:
        self.base, self.rt_tolerance, self.charges, self.most = base, rt_tolerance, charges, most
        self.height_of_cell = rt_tolerance * (1 + 1e-9) + 1e-12
        self.mz, self.rt, self.height, self.id, self.free, self.cells = [], [], [], [], bytearray(), {}
        self.next = self.offset = 0  # next monoisotopic row; number of rows that are gone

    def feed(self, id, mz, rt, height) -> dict | None:
        sound = np.isfinite(mz) & np.isfinite(rt)
        start = self.offset + len(self.mz)
        mz, rt = np.asarray(mz, float)[sound].tolist(), np.asarray(rt, float)[sound]
        self.mz += mz
        self.height += np.asarray(height, float)[sound].tolist()
        self.id += np.asarray(id)[sound].tolist()
        self.free += b"\1" * len(mz)
        for k, (cell, m) in enumerate(zip(np.floor(rt / self.height_of_cell).astype(np.int64).tolist(), mz), start):
            held = self.cells.get(cell)
            if held is None:
                held = self.cells[cell] = ([], [])
            held[0].append(m)
            held[1].append(k)
        self.rt += rt.tolist()
        return self.walk(False)

    def finish(self) -> dict | None:
        return self.walk(True)

    def walk(self, last: bool) -> dict | None:
        ids, monos, steps = [], [], []
        end = self.offset + len(self.mz)
        while self.next < end and (last or self.mz[self.next - self.offset] + self.FAR < self.mz[-1]):
            k = self.next
            self.next += 1
            if self.free[k - self.offset] and not self.height[k - self.offset] <= 0:
                for i, step in self.envelope(k):
                    ids.append(self.id[i - self.offset])
                    monos.append(self.id[k - self.offset])
                    steps.append(step)
        gone = self.next - self.offset
        if gone > 20_000 and gone > len(self.mz) // 4:
            floor = self.mz[gone] if gone < len(self.mz) else np.inf
            for x in (self.mz, self.rt, self.height, self.id, self.free):
                del x[:gone]
            self.offset += gone
            for cell in list(self.cells):
                masses, places = self.cells[cell]
                cut = bisect_left(masses, floor)
                while cut and places[cut - 1] >= self.offset:
                    cut -= 1
                del masses[:cut], places[:cut]
                if not masses:
                    del self.cells[cell]
        return {"id": ids, "mono": monos, "step": steps} if ids else None

    def near(self, held: list, mono: int, goal: float, wide: float):
        """Rows that may follow ``mono`` with m/z within about ``wide`` of ``goal``, in no order."""
        offset, low, high = self.offset, goal - wide * (1 + 1e-9) - 1e-9, goal + wide * (1 + 1e-9) + 1e-9
        mine, time, tolerance, free, rt = self.mz[mono - offset], self.rt[mono - offset], self.rt_tolerance, self.free, self.rt
        far = mine + self.FAR
        for masses, places in held:
            for at in range(bisect_left(masses, low), len(masses)):
                m = masses[at]
                if m > high or m > far:
                    break
                i = places[at]
                if m > mine and free[i - offset] and abs(rt[i - offset] - time) <= tolerance:
                    yield m, i

    def envelope(self, mono: int) -> list[tuple[int, int]]:
        offset = self.offset
        mine = self.mz[mono - offset]
        wide = max(mine * self.base / 200, self.base)
        cell = int(np.floor(self.rt[mono - offset] / self.height_of_cell))
        held = [h for h in map(self.cells.get, (cell - 1, cell, cell + 1)) if h]
        charge = 1
        for k in range(self.charges, 0, -1):  # the first window that is not empty has the first follower
            if any(abs(mine + CARBON / k - m) <= wide and not m > mine + CARBON + wide for m, _ in self.near(held, mono, mine + CARBON / k, wide)):
                charge = k
                break
        focus, misses, out, before, carbons = mine, 0, [], self.height[mono - offset], max(1, int(mine / 14))
        for step in range(1, self.most + 1):
            goal = focus + CARBON / charge
            best = None
            for m, i in self.near(held, mono, goal, wide):
                gap = abs(m - goal)
                if gap <= wide and (best is None or (gap, i) < best):
                    best = (gap, i)
            if best is None:
                focus, misses = goal, misses + 1
                if misses == 2:
                    break
                continue
            i = best[1]
            focus, misses, height = self.mz[i - offset], 0, self.height[i - offset]
            if mine <= 800:
                fine = height < before
            else:
                alkane = (carbons - step + 1) / step * (0.0107 / 0.9893) if step <= carbons else 0.0
                fine = before > 0 and abs(height / before - alkane) < 5
            if not fine:
                break
            out.append((i, step))
            before = height
        if out:
            self.free[mono - offset] = 0
            for i, _ in out:
                self.free[i - offset] = 0
        return out


class RunningMean:
    """Chromatograms of running-mean bins (``bins.running_mean_bins`` and ``binned_maxima``): mz, scan and intensity; rows by m/z.

    A bin is told once a point above the next one has come.
    """

    def __init__(self, tolerance: float, least_intensity: float, least_scans: int, ppm: float) -> None:
        self.tolerance, self.least_intensity, self.least_scans, self.ppm = tolerance, least_intensity, least_scans, ppm
        self.wide, self.moment, self.weight = None, 0.0, 0.0
        self.bins: list[float] = []  # closed ones that points may still meet
        self.wait: list[dict] = []
        self.met: list[dict] = []  # points of those bins: bin (m/z), scan, intensity

    def feed(self, mz, scan, intensity, channel_mz) -> dict | None:
        if self.wide is None:
            self.wide = max(self.tolerance, float(channel_mz[0]) * self.ppm * 1e-6)
        sound = ~np.isnan(mz)
        rows = {"mz": mz[sound], "scan": scan[sound], "intensity": intensity[sound]}
        strong = rows["intensity"] >= self.least_intensity
        closed, moment, weight, wide = len(self.bins), self.moment, self.weight, self.wide
        for v, w in zip(rows["mz"][strong].tolist(), np.maximum(rows["intensity"][strong], 1e-12).tolist()):
            if weight and v - moment / weight > wide:
                self.bins.append(moment / weight)
                moment = weight = 0.0
            moment += v * w
            weight += w
        self.moment, self.weight = moment, weight
        self.wait.append(rows)
        return self.tell(False) if len(self.bins) > closed else None

    def finish(self) -> dict | None:
        if self.weight:
            self.bins.append(self.moment / self.weight)
        return self.tell(True) if self.bins else None

    def tell(self, last: bool) -> dict | None:
        rows = joined(self.wait)
        bins = np.array(self.bins)
        ripe = np.ones(len(rows["mz"]), bool) if last else rows["mz"] <= bins[-1]
        self.wait = [rows_of(rows, ~ripe)]
        rows = rows_of(rows, ripe & (rows["intensity"] > 0))
        above = np.minimum(np.searchsorted(bins, rows["mz"]), len(bins) - 1)
        for place in (above, np.maximum(above - 1, 0)):
            near = np.abs(rows["mz"] - bins[place]) <= self.wide
            self.met.append({"bin": bins[place][near], "scan": rows["scan"][near], "intensity": rows["intensity"][near]})
        met = joined(self.met)
        order = np.lexsort((-met["intensity"], met["scan"], met["bin"]))
        met = rows_of(met, order)
        if len(order):
            first = np.r_[True, (met["bin"][1:] != met["bin"][:-1]) | (met["scan"][1:] != met["scan"][:-1])]
            met = rows_of(met, first)
        done = np.ones(len(met["bin"]), bool) if last else met["bin"] < bins[-1]
        self.met, self.bins = [rows_of(met, ~done)], self.bins[-1:]
        met = rows_of(met, done)
        _, place, n = np.unique(met["bin"], return_inverse=True, return_counts=True)
        met = rows_of(met, n[place.reshape(-1)] >= self.least_scans) if len(n) else met
        return {"mz": met["bin"], "scan": met["scan"], "intensity": met["intensity"]}


def billionths(x: np.ndarray) -> np.ndarray:
    """Numbers of at least 0 as whole billionths, halves of their shortest decimal form rounded up."""
    scaled = x * 1e9
    whole = np.floor(scaled)
    part = scaled - whole
    out = (whole + (part >= 0.5)).astype(np.int64)
    for i in np.flatnonzero(np.abs(part - 0.5) < 1e-6 * np.maximum(1.0, x)).tolist():
        out[i] = int(Decimal(repr(float(x[i]))).scaleb(9).to_integral_value(ROUND_HALF_UP))
    return out


class Assignment:
    """(id, peak): best-first 1:1 assignment of peaks (side 1) to features (side 0), by score, then id, then peak; rows by RT.

    The rows of a channel are held, but never all its pairs: features of equal times share a list of their best peaks, which is made anew from the peaks
    that are left when it is used up. A channel is not cut at gaps, since an id that comes twice may be on both sides of one.
    """

    LIST = 16

    def __init__(self, tolerance: float, weight: float) -> None:
        self.tolerance, self.weight, self.run = tolerance, weight, []

    def feed(self, **rows) -> None:
        self.run.append(rows)

    def finish(self) -> dict | None:
        return self.settle() if self.run else None

    def score(self, a: dict, b: dict) -> np.ndarray:
        close = 1 - np.abs(a["rt"] - b["rt"]) / self.tolerance
        with np.errstate(invalid="ignore", divide="ignore"):  # a missing bound does not bound
            shared = np.fmax(0.0, np.fmin(a["right"], b["right"]) - np.fmax(a["left"], b["left"]))
            narrow = np.fmin(a["right"] - a["left"], b["right"] - b["left"])
            ratio = np.where(narrow > 0, np.fmin(1.0, shared / narrow), 0.0)
        return billionths((1 - self.weight) * close + self.weight * ratio)

    def settle(self) -> dict:
        every, self.run = joined(self.run), []
        mine, theirs = rows_of(every, every["side"] == 0), rows_of(every, every["side"] == 1)
        found: dict = {"id": [], "peak": []}
        if not len(mine["id"]) or not len(theirs["id"]):
            return found
        order = np.lexsort((mine["id"], mine["right"], mine["left"], mine["rt"]))
        mine = rows_of(mine, order)
        same = np.ones(len(order) - 1, bool)
        for c in ("rt", "left", "right"):
            same &= (mine[c][1:] == mine[c][:-1]) | (np.isnan(mine[c][1:]) & np.isnan(mine[c][:-1]))
        heads = np.r_[0, np.flatnonzero(~same) + 1]
        ends = np.r_[heads[1:], len(order)].tolist()
        kinds = rows_of(mine, heads)  # features of equal times
        at = heads.tolist()  # the next feature of each kind
        ids, peaks = mine["id"].tolist(), theirs["id"].tolist()
        slack = self.tolerance * 1e-9 + 1e-12
        low = np.searchsorted(theirs["rt"], kinds["rt"] - self.tolerance - slack * (1 + np.abs(kinds["rt"])), "left")
        high = np.searchsorted(theirs["rt"], kinds["rt"] + self.tolerance + slack * (1 + np.abs(kinds["rt"])), "right")
        left = np.ones(len(peaks), bool)
        copies: dict = {}
        if len(set(peaks)) < len(peaks):
            for row, peak in enumerate(peaks):
                copies.setdefault(peak, []).append(row)

        def lists(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """(kind, score, peak row) of the best peaks left of some kinds in order, and the number of each kind's candidates."""
            k, row = spread(low[some], high[some])
            good = left[row]
            k, row = k[good], row[good]
            good = np.abs(kinds["rt"][some][k] - theirs["rt"][row]) <= self.tolerance
            k, row = k[good], row[good]
            s = self.score(rows_of(kinds, some[k]), rows_of(theirs, row))
            order = np.lexsort((theirs["id"][row], -s, k))
            k, row, s = k[order], row[order], s[order]
            n = np.bincount(k, minlength=len(some))
            top = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) < self.LIST
            return k[top], s[top], row[top], n

        best: list = [None] * len(heads)  # scores and rows from the worst to the best, so that they are taken off the end
        more = [False] * len(heads)

        def fill(some: np.ndarray) -> None:
            k, s, row, n = lists(some)
            held = np.minimum(n, self.LIST)
            end = 0
            s, row = s.tolist(), row.tolist()
            for kind, h, all_ in zip(some.tolist(), held.tolist(), n.tolist()):
                best[kind] = (s[end : end + h][::-1], row[end : end + h][::-1])
                more[kind] = all_ > h
                end += h

        alive = left.tolist()
        used: set = set()
        unique = len(set(ids)) == len(ids)
        heap: list = []

        def push(kind: int) -> None:
            while not unique and at[kind] < ends[kind] and ids[at[kind]] in used:
                at[kind] += 1
            if at[kind] == ends[kind]:
                best[kind] = None
                return
            scores, rows = best[kind]
            while True:
                while rows and not alive[rows[-1]]:
                    rows.pop()
                    scores.pop()
                if rows or not more[kind]:
                    break
                fill(np.array([kind]))
                scores, rows = best[kind]
            if rows:
                heapq.heappush(heap, (-scores[-1], ids[at[kind]], peaks[rows[-1]], rows[-1], kind))

        begin = 0
        while begin < len(heads):
            took = fitting(high[begin:] - low[begin:])
            fill(np.arange(begin, begin + took))
            begin += took
        for kind in range(len(heads)):
            push(kind)
        while heap:
            _, id_, peak, row, kind = heapq.heappop(heap)
            if alive[row] and (unique or id_ not in used):
                found["id"].append(id_)
                found["peak"].append(peak)
                if not unique:
                    used.add(id_)
                at[kind] += 1
                for r in copies.get(peak, (row,)):
                    alive[r] = left[r] = False
            push(kind)
        return found
