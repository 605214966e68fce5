"""Search of spectra in a library: bucketed candidate join, scoring in Arrow batches, ranking, late payload."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.kernels import blocks as B
from peakloom.kernels import similarity as K
from peakloom.operators.spectra import arrays_of
from peakloom.plans.bands import band_join, top_k


def candidates(queries: DataFrame, library: DataFrame, tolerance: float) -> DataFrame:
    """query_id, ref_id, query_mz, ref_mz, peaks_a and peaks_b of pairs whose precursors are within the tolerance.

    Inputs have spec_id, precursor and peaks. Ids and precursors are joined first; peaks follow.
    """
    left = queries.select(F.col("spec_id").alias("query_id"), F.col("precursor").alias("query_mz"), F.col("peaks").alias("peaks_a"))
    right = library.select(F.col("spec_id").alias("ref_id"), F.col("precursor").alias("ref_mz"), F.col("peaks").alias("peaks_b"))
    return band_join(left, right, "query_mz", "ref_mz", tolerance)


def score_candidates(queries: DataFrame, library: DataFrame, tolerance: float, blocks: Callable, kernel: Callable[..., dict], schema: str, most: tuple[int, int] = (1024, 2048)) -> DataFrame:
    """query_id, ref_id and ``schema`` of each pair of different ids whose precursors are within the tolerance.

    Inputs have spec_id, precursor and peaks. Spectra travel once to a cell of precursors (references to all cells in reach), not once
    a pair; crowded cells are dealt into chunks of about ``most`` queries and references, so that a task holds one chunk of each.
    ``blocks(q, r)`` scores all pairs of a block; where it returns None, ``kernel(mz_q, int_q, mz_r, int_r, precursor_q, precursor_r)`` takes each.
    """
    cell = lambda v: F.floor(v / tolerance).cast("long")
    reach = tolerance * (1 + 1e-9) + F.abs(F.col("precursor")) * 1e-12  # rounding must lose no pair
    left = queries.select("spec_id", "precursor", "peaks", cell(F.col("precursor")).alias("cell"))
    right = library.select(*[F.col(c).alias(c) for c in ("spec_id", "precursor", "peaks")], F.explode(F.sequence(cell(F.col("precursor") - reach), cell(F.col("precursor") + reach))).alias("cell"))
    chunks = lambda df, n, name: df.groupBy("cell").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    dealt = chunks(left, most[0], "of_q").join(chunks(right, most[1], "of_r"), "cell")
    mine = lambda of: F.pmod(F.xxhash64("spec_id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    keys = ["cell", "q", "r"]
    left = left.join(dealt, "cell").withColumn("q", mine("of_q")).withColumn("r", every("of_r")).select(*keys, "spec_id", "precursor", "peaks")
    right = right.join(dealt, "cell").withColumn("r", mine("of_r")).withColumn("q", every("of_q")).select(*[F.col(c).alias(f"{c}_r") for c in [*keys, "spec_id", "precursor", "peaks"]])
    out = left.select(F.col("spec_id").alias("query_id")).schema.add("ref_id", library.schema["spec_id"].dataType)
    for f in queries.sparkSession.createDataFrame([], schema).schema:
        out = out.add(f)
    names = out.names[2:]
    from pyspark.sql.pandas.types import to_arrow_schema

    form = to_arrow_schema(out)

    def side(rows: pa.Table) -> tuple[pa.ChunkedArray, B.Side]:
        rows = rows.rename_columns([*keys, "spec_id", "precursor", "peaks"])
        found = [x for part in rows.column("peaks").chunks for x in arrays_of(part)]
        flat = [np.concatenate([x[k] for x in found]) if found else np.zeros(0) for k in (0, 1)]
        return rows.column("spec_id"), B.Side(np.asarray(rows.column("precursor"), float), np.array([len(x[0]) for x in found], np.int64), *flat)

    def runs(values: np.ndarray) -> list[np.ndarray]:
        """Rows in narrow runs of precursors, so that frames shifted by them differ little within a run."""
        order = np.argsort(values, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(np.floor(values[order] / (tolerance / 4)))) + 1)

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        (id_q, q), (id_r, r) = side(a), side(b)
        parts = []
        for i in runs(q.precursor) if len(q.counts) else []:
            for j in runs(r.precursor) if len(r.counts) else []:
                near = np.abs(q.precursor[i][:, None] - r.precursor[j][None, :]) <= tolerance
                if not near.any():
                    continue
                x, y = np.nonzero(near)
                unlike = np.asarray(pc.fill_null(pc.not_equal(id_q.take(pa.array(i[x])), id_r.take(pa.array(j[y]))), False))
                x, y = x[unlike], y[unlike]
                mine, theirs = q.take(i), r.take(j)
                found = blocks(mine, theirs)
                if found is None:
                    rows = [kernel(*mine.spectrum(m), *theirs.spectrum(n), float(mine.precursor[m]), float(theirs.precursor[n])) for m, n in zip(x.tolist(), y.tolist())]
                    values = [[row[name] for row in rows] for name in names]
                else:
                    values = [found[name][x, y] for name in names]
                columns = [id_q.take(pa.array(i[x])).combine_chunks(), id_r.take(pa.array(j[y])).combine_chunks(), *(pa.array(v, form.field(n).type) for n, v in zip(names, values))]
                parts.append(pa.Table.from_arrays(columns, schema=form))
        return pa.concat_tables(parts) if parts else form.empty_table()

    return left.groupBy(*keys).cogroup(right.groupBy(*[f"{k}_r" for k in keys])).applyInArrow(score, out)


def products(queries: DataFrame, library: DataFrame, precursors: float, tolerance: float) -> DataFrame:
    """Number of matched peaks and the sum of their intensity products."""

    def kernel(ma, ia, mb, ib, p, q):
        total, n = K.product(ma, ia, mb, ib, tolerance)
        return {"n_matched": n, "total": total}

    return score_candidates(queries, library, precursors, lambda q, r: B.products(q, r, tolerance), kernel, "n_matched long, total double")


def cosines(queries: DataFrame, library: DataFrame, precursors: float, tolerance: float) -> DataFrame:
    """Cosine over matched peaks and their number."""
    kernel = lambda ma, ia, mb, ib, p, q: dict(zip(("score", "n_matched"), K.cosine(ma, ia, mb, ib, tolerance)))
    return score_candidates(queries, library, precursors, lambda q, r: B.cosines(q, r, tolerance), kernel, "n_matched long, score double")


def modified_cosines(queries: DataFrame, library: DataFrame, precursors: float, tolerance: float) -> DataFrame:
    """The better of the direct and the precursor-shifted cosine."""
    kernel = lambda ma, ia, mb, ib, p, q: dict(zip(("score", "n_matched"), K.modified_cosine(ma, ia, mb, ib, p, q, tolerance)))
    return score_candidates(queries, library, precursors, lambda q, r: B.modified_cosines(q, r, tolerance), kernel, "n_matched long, score double")


def loss_cosines(queries: DataFrame, library: DataFrame, precursors: float, tolerance: float, above: float = 0.0) -> DataFrame:
    """Cosine of the losses from the precursors and ``above``."""
    kernel = lambda ma, ia, mb, ib, p, q: dict(zip(("score", "n_matched"), K.neutral_loss_cosine(ma, ia, mb, ib, p + above, q + above, tolerance)))
    return score_candidates(queries, library, precursors, lambda q, r: B.loss_cosines(q, r, tolerance, above), kernel, "n_matched long, score double")


def identities(queries: DataFrame, library: DataFrame, precursors: float, tolerance: float, least: float, peaks: int = 3, digits: int = 6) -> DataFrame:
    """SAME, DIFFERENT or UNJUDGEABLE by the rounded cosine and the number of matches."""

    def kernel(ma, ia, mb, ib, p, q):
        state, score, n = K.identity(ma, ia, mb, ib, tolerance, 0.0, peaks)
        return {"state": state if state == "UNJUDGEABLE" or round(score, digits) >= least else "DIFFERENT"}

    def block(q, r):
        found = B.cosines(q, r, tolerance)
        if found is None:
            return None
        same = (np.round(found["score"], digits) >= least) & (found["n_matched"] >= peaks)
        few = (q.counts < peaks)[:, None] | (r.counts < peaks)[None, :]
        return {"state": np.where(few, "UNJUDGEABLE", np.where(same, "SAME", "DIFFERENT"))}

    return score_candidates(queries, library, precursors, block, kernel, "state string")


def composite_scores(queries: DataFrame, library: DataFrame, precursors: float, tolerance: float) -> DataFrame:
    """All scores of each pair; the frame shifted by the precursors is tried too."""
    kernel = lambda ma, ia, mb, ib, p, q: K.composite(ma, ia, mb, ib, tolerance, p, q)
    return score_candidates(queries, library, precursors, lambda q, r: B.composites(q, r, tolerance), kernel, "score double, n_matched long, wdp double, sdp double, rdp double, matched_pct double")


def high_confidence(score: Column, matched: Column, least: float, peaks: int) -> Column:
    return (score >= least) & (matched >= peaks)


def top_hits(scored: DataFrame, most: int, least_matched: int) -> DataFrame:
    """The best hits of each query with enough matches, ties by library order."""
    return top_k(scored.where(F.col("n_matched") >= least_matched), ["query_id"], [F.desc("score"), F.col("ref_id")], most, "place")


def matched_bound(queries: DataFrame, library: DataFrame, precursors: float, tolerance: float) -> DataFrame:
    """An upper bound of the matched share: strong reference peaks with any query peak near."""

    def kernel(ma, ia, mb, ib, p, q):
        strong = mb[ib >= ib.max() * 0.01] if len(ib) else mb
        ranked = np.sort(ma)
        near = np.searchsorted(ranked, strong + tolerance, "right") > np.searchsorted(ranked, strong - tolerance, "left")
        return {"bound": float(near.sum()) / max(len(strong), 1)}

    return score_candidates(queries, library, precursors, lambda q, r: B.bounds(q, r, tolerance), kernel, "bound double")


def bucket_index(library: DataFrame) -> DataFrame:
    """spec_id, cell (rounded precursor), peaks and the place of its first peak in the cell's flat arrays."""
    rows = library.select("spec_id", F.bround("precursor").cast("int").alias("cell"), F.size("peaks").cast("long").alias("peaks"))
    running = F.sum("peaks").over(Window.partitionBy("cell").orderBy("spec_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("start", running - F.col("peaks"))


def gaussian(value: Column, reference: Column, tolerance: float) -> Column:
    """exp(-0.5 (difference / tolerance)^2); 0 where either side is null or the tolerance is not positive."""
    if tolerance <= 0:
        return F.lit(0.0)
    return F.coalesce(F.exp(-0.5 * F.pow((value - reference) / tolerance, 2)), F.lit(0.0))


def rerank(hits: DataFrame, score: Column) -> DataFrame:
    """Hits in the order of another score; any expression, a registered function too, can be the plug-in."""
    rescored = hits.withColumn("reranked", F.round(score, 5))
    return rescored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("reranked"), "ref_id")))


def acquired_only(peaks: DataFrame, ions: DataFrame, tolerance: float) -> DataFrame:
    """Reference peaks with an acquired ion within the tolerance."""
    return band_join(peaks, ions, "mz", "acquired", tolerance, how="left_semi")


def boosted_cosine(queries: DataFrame, library: DataFrame, precursors: float, least_shared: int) -> DataFrame:
    """Squared weighted cosine (square root of intensity times m/z squared), blended with the consistency of neighbouring ratios."""

    def kernel(ma, ia, mb, ib, p, q):
        shared, at_a, at_b = np.intersect1d(ma, mb, return_indices=True)
        wa, wb = np.sqrt(ia) * ma**2, np.sqrt(ib) * mb**2
        norm = float((wa**2).sum() * (wb**2).sum())
        score = float((wa[at_a] * wb[at_b]).sum()) ** 2 / norm if norm > 0 else 0.0
        m, union = len(shared), len(ma) + len(mb) - len(shared)
        if m >= max(least_shared, 2):
            ratio = (ia[at_a][1:] / ia[at_a][:-1]) * (ib[at_b][:-1] / ib[at_b][1:])
            score = (union * score + m * float(np.minimum(ratio, 1 / ratio).sum()) / (m - 1)) / (union + m)
        return {"score": score, "shared": m}

    def block(q, r):
        return B.boosted(q, r) if least_shared >= 2 else None

    return score_candidates(queries, library, precursors, block, kernel, "score double, shared long").where(F.col("shared") >= least_shared)


def match_factors(queries: DataFrame, library: DataFrame, precursors: float, tolerance: float, penalty: float = 0.02) -> DataFrame:
    """GC-MS match factor: (3 WDP + 3 SDP + 2 RDP + matched share) / 9 less ``penalty``, scaled by spectrum complexity."""

    def kernel(ma, ia, mb, ib, p, q):
        c = K.composite(ma, ia, mb, ib, tolerance)
        factor = (3 * c["wdp"] + 3 * c["sdp"] + 2 * c["rdp"] + c["matched_pct"]) / 9
        return {"match_factor": max(0.0, factor - penalty) * min(1.0, len(mb) / 5), "n_matched": c["n_matched"]}

    return score_candidates(queries, library, precursors, lambda q, r: B.match_factors(q, r, tolerance, penalty), kernel, "match_factor double, n_matched long")


def annotate(queries: DataFrame, library: DataFrame, tolerance: float = 0.5, score_floor: float = 0.7, least_matched: int = 3, most: int = 5) -> DataFrame:
    """Top hits of each query as one array of (rank, ref_id, score, n_matched, ref_peaks); peaks join after ranking.

    Hits under ``score_floor`` are unnamed: they are dropped from the array.
    """
    best = top_hits(composite_scores(queries, library, tolerance, 0.02).where(F.col("score") >= score_floor), most, least_matched)
    payload = library.select(F.col("spec_id").alias("ref_id"), F.col("peaks").alias("ref_peaks"))
    hit = F.struct(F.col("place").alias("rank"), "ref_id", "score", "n_matched", "ref_peaks")
    return best.join(payload, "ref_id").groupBy("query_id").agg(F.sort_array(F.collect_list(hit)).alias("matches"))
