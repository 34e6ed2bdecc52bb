"""Fits and filters of long recordings over chunks of frames: whitening, FastICA, Infomax, SOBI and JADE from sums over chunks, and the causal
low-pass as a scan.

Panels of up to HELD bytes go through the rounds of an iterative fit in one task. For longer ones a round reads each chunk once, as one block of doubles, and returns sums whose size depends on the number of components only; the
sums of all chunks are added up and one small task for each panel makes the next rotation. So no task holds a recording. The steps are
those of the kernels, which fit a recording in one task; results agree but for the order of sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import bss, spectral
from ..scratch import forget, saved, written
from .bss import _names, _nothing, _types
from .lagged import CHUNK, REC, lagged_products, square, with_halo

#: Variances under this share of the largest are rounding.
RANK_TOLERANCE = 1e-12
#: Bytes of a panel's blocks that one task holds, with a few times as much for its sums.
HELD = 32 << 20
_MODEL = "component int, unmixing array<double>, mixing array<double>, mean array<double>, energy double, rounds int, converged boolean"


def blocks(wide: DataFrame, keys: Sequence[str] = REC, chunk: int = CHUNK) -> DataFrame:
    """keys, block: the frames of a chunk one after the other as doubles, and d, the number of series."""

    def one(own: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(own.sort_values("time_index", kind="stable")["x"].to_list()).astype(float)
        return pd.DataFrame({k: [own[k].iloc[0]] for k in keys} | {"block": [x.tobytes()], "d": [x.shape[1]]})

    placed = wide.select(*keys, F.floor(F.col("time_index") / chunk).alias("_chunk"), "time_index", "x")
    return placed.groupBy(*keys, "_chunk").applyInPandas(one, f"{_types(wide, keys)}, block binary, d int")


def _summed(rows: DataFrame, keys: Sequence[str], work: Callable[[dict], np.ndarray]) -> DataFrame:
    """keys and `sums`: the sum of work(row) over all rows of a key as binary doubles; cells are added up before they are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own in batch.to_dict("records"):
                values = work(own).ravel()
                yield pd.DataFrame({k: [own[k]] * len(values) for k in keys} | {"cell": np.arange(len(values)), "value": values})

    cells = rows.mapInPandas(run, f"{_types(rows, keys)}, cell long, value double").groupBy(*keys, "cell").agg(F.sum("value").alias("value"))

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({k: [own[k].iloc[0]] for k in keys} | {"sums": [own.sort_values("cell")["value"].to_numpy(float).tobytes()]})

    return cells.groupBy(*keys).applyInPandas(pack, f"{_types(rows, keys)}, sums binary")


def _each(rows: DataFrame, keys: Sequence[str], work: Callable[[dict], dict], schema: str) -> DataFrame:
    """One row for each row: its keys and what work(row) returns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [{k: own[k] for k in keys} | work(own) for own in batch.to_dict("records")]
            yield pd.DataFrame(out, columns=names)

    names = [*keys, *(c.split()[0] for c in schema.split(", "))]
    return rows.mapInPandas(run, f"{_types(rows, keys)}, {schema}")


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(rows, -1)


def whitening(data: DataFrame, components: int | None, keys: Sequence[str] = REC) -> DataFrame:
    """keys, n, mean and white (the map of centered frames to `components` decorrelated coordinates of unit variance, at most one less than there
    are frames; None: all that have variance), from two passes over blocks.
    """

    def first(own: dict) -> np.ndarray:
        x = np.frombuffer(own["block"]).reshape(-1, own["d"])
        return np.append(x.sum(axis=0), len(x))

    means = _each(_summed(data, keys, first), keys, lambda own: {"mean": (np.frombuffer(own["sums"])[:-1] / np.frombuffer(own["sums"])[-1]).tobytes(), "n": int(np.frombuffer(own["sums"])[-1])}, "mean binary, n long")
    means = saved(means, "means")

    def second(own: dict) -> np.ndarray:
        x = np.frombuffer(own["block"]).reshape(-1, own["d"]) - np.frombuffer(own["mean"])  # centered before it is multiplied
        return x.T @ x

    def axes(own: dict) -> dict:
        c = square(own["sums"])
        if components is not None and not 1 <= components <= len(c):
            raise ValueError(f"the number of components must be between 1 and {len(c)}, got {components}")
        variance, vectors = np.linalg.eigh(c / max(1, own["n"] - 1))
        k = int((variance > RANK_TOLERANCE * max(variance[-1], 0)).sum()) if components is None else min(components, own["n"] - 1)
        variance, vectors = variance[::-1][:k], vectors.T[::-1][:k]
        lead = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]
        vectors = vectors * np.where(lead < 0, -1.0, 1.0)[:, None]
        return {"mean": own["mean"], "n": own["n"], "white": (vectors / np.sqrt(np.maximum(variance, np.finfo(float).eps))[:, None]).tobytes()}

    products = _summed(data.join(means, list(keys)), keys, second).join(means, list(keys))
    return _each(products, keys, axes, "mean binary, n long, white binary")


def _white(own: dict) -> np.ndarray:
    """A block's frames in white coordinates."""
    mean = np.frombuffer(own["mean"])
    return (np.frombuffer(own["block"]).reshape(-1, len(mean)) - mean) @ np.frombuffer(own["white"]).reshape(-1, len(mean)).T


_STATE = "mean binary, n long, white binary, turn binary, memory array<double>, round int, done boolean"


def _iterated(data: DataFrame, state: DataFrame, keys: Sequence[str], sums: Callable[[dict], np.ndarray], step: Callable[[dict], dict], most: int, held: int) -> DataFrame:
    """state(keys, mean, n, white, turn, memory, round, done) after rounds of step(state with sums) until all are done, `most` at most.

    A panel whose blocks have `held` bytes at most goes through all of its rounds in one task; the rounds of longer ones are jobs over their chunks.
    """
    sizes = data.groupBy(*keys).agg((F.sum(F.length("block")) <= held).alias("_short"))
    placed = saved(state.join(sizes, list(keys)), "start")
    names = [*keys, *_names(_STATE)]

    def run(blocks: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if own.empty or blocks.empty:
            return _nothing(names)
        own = own.iloc[0].to_dict()
        block = b"".join(sorted(blocks["block"]))  # sums don't depend on the chunks' order, their last bits do
        for _ in range(most):
            if own["done"]:
                break
            own |= step(own | {"sums": sums(own | {"block": block}).ravel().tobytes()})
        return pd.DataFrame({c: [own[c]] for c in names})

    short = placed.filter("_short").drop("_short")
    blocks = data.join(short.select(*keys), list(keys), "left_semi")
    ended = saved(blocks.groupBy(*keys).cogroup(short.groupBy(*keys)).applyInPandas(run, f"{_types(state, keys)}, {_STATE}"), "turn")
    now, path = written(placed.filter("NOT _short").drop("_short"), "turn")
    for _ in range(most):
        open_ = now.filter("NOT done")
        if open_.isEmpty():
            break
        totals = _summed(data.join(open_, list(keys)), keys, sums)
        moved = _each(open_.join(totals, list(keys)), keys, step, _STATE)
        before = path
        now, path = written(now.filter("done").unionByName(moved), "turn")
        forget(data.sparkSession, before)
    return ended.unionByName(now)


def _turned(own: dict) -> tuple[np.ndarray, int]:
    turn = square(own["turn"])
    return turn, len(turn)


def fastica_turn(data: DataFrame, white: DataFrame, keys: Sequence[str], tol: float, rounds: int, seed: int, held: int = HELD) -> DataFrame:
    """Symmetric FastICA with the log cosh contrast; turn's rows are the sources' directions."""

    def start(own: dict) -> dict:
        k = len(np.frombuffer(own["white"])) // len(np.frombuffer(own["mean"]))
        w = bss.decorrelated(np.random.default_rng(seed).standard_normal((k, k)))
        return {c: own[c] for c in ("mean", "n", "white")} | {"turn": w.tobytes(), "memory": [], "round": 0, "done": False}

    def sums(own: dict) -> np.ndarray:
        z, (w, _) = _white(own), _turned(own)
        g = np.tanh(z @ w.T)
        return np.column_stack([g.T @ z, (1 - g**2).sum(axis=0)])

    def step(own: dict) -> dict:
        w, k = _turned(own)
        total = _matrix(own["sums"], k) / own["n"]
        new = bss.decorrelated(total[:, :-1] - total[:, -1:] * w)
        change = np.abs(np.abs((new * w).sum(axis=1)) - 1).max()
        return {c: own[c] for c in ("mean", "n", "white")} | {"turn": new.tobytes(), "memory": [], "round": own["round"] + 1, "done": bool(change < tol)}

    return _iterated(data, _each(white, keys, start, _STATE), keys, sums, step, rounds, held)


def infomax_turn(data: DataFrame, white: DataFrame, keys: Sequence[str], tol: float, rounds: int, seed: int, held: int = HELD) -> DataFrame:
    """Infomax over rotations of white data by the kernel's search, a pass over the blocks for each trial.

    turn is the trial's rotation; memory holds the search but for its first trial: step, whether it is the first, accepted rounds, cost, and the
    matrices of rotation, slope and pairs.
    """

    def start(own: dict) -> dict:
        k = len(np.frombuffer(own["white"])) // len(np.frombuffer(own["mean"]))
        return {c: own[c] for c in ("mean", "n", "white")} | {"turn": bss.infomax_start(k, seed).turn.tobytes(), "memory": [], "round": 0, "done": False}

    def sums(own: dict) -> np.ndarray:
        moment, cost = bss.infomax_moments(_white(own) @ _turned(own)[0])
        return np.append(moment.ravel(), cost)

    def search_of(memory: Sequence[float], turn: np.ndarray) -> bss.Search:
        if not len(memory):
            return bss.Search(turn)
        size, first, accepted, cost = memory[:4]
        old, slope, *of_pairs = np.reshape(memory[4:], (-1, *turn.shape))
        return bss.Search(old, slope, cost, size, bool(first), int(accepted), tuple(zip(of_pairs[::2], of_pairs[1::2], strict=True)))

    def step(own: dict) -> dict:
        turn, k = _turned(own)
        total = np.frombuffer(own["sums"]) / own["n"]
        search = search_of(own["memory"], turn).told(turn, total[:-1].reshape(k, k), total[-1])
        done = search.stationary(tol) or search.rounds >= rounds
        memory = np.concatenate([[search.step, search.first, search.rounds, search.cost], *map(np.ravel, [search.turn, search.slope, *(m for pair in search.pairs for m in pair)])])
        return {c: own[c] for c in ("mean", "n", "white")} | {"turn": (search.turn if done else search.trial()).tobytes(), "memory": memory.tolist(), "round": search.rounds, "done": done}

    return _iterated(data, _each(white, keys, start, _STATE), keys, sums, step, 60 * rounds, held)


def _joint(rows: DataFrame, keys: Sequence[str], matrices: Callable[[dict], np.ndarray], tol: float, rounds: int) -> DataFrame:
    """The rotation that makes matrices(row) diagonal together."""

    def turn(own: dict) -> dict:
        found, n, ok = bss.joint_rotation(matrices(own), tol, rounds)
        return {c: own[c] for c in ("mean", "n", "white")} | {"turn": found.tobytes(), "memory": [], "round": n, "done": ok}

    return _each(rows, keys, turn, _STATE)


def sobi_turn(wide: DataFrame, white: DataFrame, keys: Sequence[str], tol: float, rounds: int, lags: Sequence[int], chunk: int) -> DataFrame:
    """From lagged products of the centered series; white coordinates are linear in these, so they need no pass of their own."""
    centers = _each(white, keys, lambda own: {"_center": np.frombuffer(own["mean"]).tolist()}, "_center array<double>")
    centered = wide.join(centers, list(keys)).withColumn("x", F.zip_with("x", "_center", lambda v, m: v - m))
    sums = lagged_products(centered, lags, keys, chunk)
    packed = sums.filter("n > 0").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lag", "source", "target", "product", "n"))).alias("products"))

    def matrices(own: dict) -> np.ndarray:
        d = len(np.frombuffer(own["mean"]))
        t = np.frombuffer(own["white"]).reshape(-1, d)
        c = np.array([p["product"] / p["n"] for p in own["products"]]).reshape(-1, d, d)
        turned = t @ c @ t.T
        return (turned + turned.transpose(0, 2, 1)) / 2

    return _joint(white.join(packed, list(keys)), keys, matrices, tol, rounds)


def jade_turn(data: DataFrame, white: DataFrame, keys: Sequence[str], tol: float, rounds: int, cumulants: int) -> DataFrame:
    """From fourth moments of the white coordinates, `cumulants` matrices at most."""

    def sums(own: dict) -> np.ndarray:
        z = _white(own)
        pairs = np.stack(np.triu_indices(z.shape[1]), axis=1)[:cumulants]
        return np.stack([(z * (z[:, a] * z[:, b])[:, None]).T @ z for a, b in pairs])

    def matrices(own: dict) -> np.ndarray:
        k = len(np.frombuffer(own["white"])) // len(np.frombuffer(own["mean"]))
        return bss.cumulants_of(np.frombuffer(own["sums"]).reshape(-1, k, k) / own["n"])

    return _joint(white.join(_summed(data.join(white, list(keys)), keys, sums), list(keys)), keys, matrices, tol, rounds)


def ready_to_fit(wide: DataFrame, components: int, keys: Sequence[str] = REC, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The blocks of wide frames and their whitening."""
    data = saved(blocks(wide, keys, chunk), "blocks")
    return data, saved(whitening(data, components, keys).filter("n > 1"), "whitening")


def fit_by_chunks(
    wide: DataFrame, method: str, components: int, keys: Sequence[str] = REC, tol: float = 1e-4, rounds: int = 500, seed: int = 0, lags: Sequence[int] = (1, 2, 3, 5), cumulants: int = 200, chunk: int = CHUNK,
    held: int = HELD, ready: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Models of wide frames (keys, time_index, x) as those of fit_bss, for recordings of any length: keys, component, unmixing, mixing, mean, energy,
    rounds and converged. Components come in falling order of energy, each column of the mixing with a positive largest loading. Lags of SOBI don't
    reach over gaps of time. Recordings of few frames have one component less than frames at most, so one frame alone has no model. `ready` is what ready_to_fit makes of them, for several fits.
    """
    data, white = ready or ready_to_fit(wide, components, keys, chunk)
    if method == "fastica":
        turned = fastica_turn(data, white, keys, tol, rounds, seed, held)
    elif method == "infomax":
        turned = infomax_turn(data, white, keys, tol, rounds, seed, held)
    elif method == "sobi":
        turned = sobi_turn(wide, white, keys, tol, rounds, lags, chunk)
    elif method == "jade":
        turned = jade_turn(data, white, keys, tol, rounds, cumulants)
    else:
        raise ValueError(f"unknown method {method!r}")
    rows_are_sources, ended = method == "fastica", rounds if method == "infomax" else None  # infomax is also done when its rounds are used up

    def models(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own in batch.to_dict("records"):
                mean, turn = np.frombuffer(own["mean"]), square(own["turn"])
                unmixing = (turn if rows_are_sources else turn.T) @ np.frombuffer(own["white"]).reshape(-1, len(mean))
                mixing = np.linalg.pinv(unmixing)
                order = np.argsort(-(mixing**2).sum(axis=0), kind="stable")
                lead = mixing[np.abs(mixing).argmax(axis=0), np.arange(len(turn))]
                sign = np.where(lead < 0, -1.0, 1.0)
                unmixing, mixing = (unmixing * sign[:, None])[order], (mixing * sign)[:, order]
                k = len(turn)
                energy = [(own["n"] - 1) / own["n"]] * k  # a rotation of white coordinates keeps their variance
                yield pd.DataFrame({c: [own[c]] * k for c in keys} | {"component": np.arange(k), "unmixing": list(unmixing), "mixing": list(mixing.T), "mean": [mean] * k, "energy": energy, "rounds": own["round"], "converged": own["done"] and own["round"] != ended})

    return turned.mapInPandas(models, f"{_types(wide, keys)}, {_MODEL}")


def lowpass(frames: DataFrame, cutoffs: Sequence[float], rate: float, keys: Sequence[str] = ("recording", "fold"), side: str = "role", chunk: int = CHUNK) -> DataFrame:
    """Causal low-pass variants of wide frames: keys, time_index, `side`, x and variant; the state starts anew in every run of frames of one side
    (train or not) without a gap.

    A filter's end state is an affine map of the state at its start. 1. Each chunk is filtered from rest and returns its end state. 2. For each panel
    the few numbers of all chunks are composed in order, which gives the state at each chunk's start. 3. Each chunk is filtered from that state.
    """
    names = [f"causal_lowpass/{c:g}hz" for c in cutoffs]
    rows = with_halo(frames.select(*keys, "time_index", side, "x"), 1, chunk)

    def parts(own: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, bool]:
        """The chunk's own frames in order, where its runs start, and whether the first goes on from the chunk before."""
        own = own.sort_values("time_index", kind="stable")
        t, train = own["time_index"].to_numpy(np.int64), (own[side] == "train").to_numpy()
        new = np.concatenate([[True], (np.diff(t) != 1) | (train[1:] != train[:-1])])
        mine = t >= int(own["_chunk"].iloc[0]) * chunk
        first = int(np.flatnonzero(mine)[0]) if mine.any() else len(t)
        goes_on = 0 < first < len(t) and not new[first]
        own, new = own[mine], new[mine]
        starts = np.flatnonzero(new)
        return own, np.unique(np.concatenate([[0], starts])).astype(int) if len(own) else starts, goes_on

    def ends(own: pd.DataFrame) -> pd.DataFrame:
        kept, starts, goes_on = parts(own)
        if not len(kept):
            return _nothing([*keys, "_chunk", "filter", "through", "goes_on", "n", "state"])
        x = np.stack(kept["x"].to_list()[starts[-1] :]).astype(float)
        states = [spectral.Lowpass(c, rate).run(x)[1].tobytes() for c in cutoffs]
        same = {k: [own[k].iloc[0]] * len(states) for k in (*keys, "_chunk")}
        return pd.DataFrame(same | {"filter": np.arange(len(states)), "through": goes_on and len(starts) == 1, "goes_on": goes_on, "n": len(x), "state": states})

    schema = f"{_types(rows, [*keys, '_chunk'])}, filter int, through boolean, goes_on boolean, n long, state binary"
    local = rows.groupBy(*keys, "_chunk").applyInPandas(ends, schema)

    def compose(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_chunk")
        low, before, entry = spectral.Lowpass(cutoffs[int(own["filter"].iloc[0])], rate), None, []
        for r in own.itertuples():
            mine = np.frombuffer(r.state).reshape(low.order, -1)
            start = before if r.goes_on and before is not None else np.zeros_like(mine)
            entry.append(start.tobytes())
            before = low.power(r.n) @ start + mine if r.through else mine
        return pd.DataFrame({k: own[k] for k in (*keys, "_chunk", "filter")} | {"state": entry})

    entries = local.groupBy(*keys, "filter").applyInPandas(compose, f"{_types(rows, [*keys, '_chunk'])}, filter int, state binary")

    def final(own: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        kept, starts, _ = parts(own)
        out = []
        if len(kept):
            x = np.stack(kept["x"].to_list()).astype(float)
            edges = [*starts, len(x)]
            for r in entry.itertuples():
                low = spectral.Lowpass(cutoffs[r.filter], rate)
                first = np.frombuffer(r.state).reshape(low.order, -1)
                y = np.concatenate([low.run(x[a:b], first if a == 0 else None)[0] for a, b in zip(edges, edges[1:], strict=False)])
                out.append(kept.assign(x=list(y), variant=names[r.filter])[[*keys, "time_index", side, "x", "variant"]])
        return pd.concat(out) if out else _nothing([*keys, "time_index", side, "x", "variant"])

    both = rows.groupBy(*keys, "_chunk").cogroup(entries.groupBy(*keys, "_chunk"))
    return both.applyInPandas(final, f"{_types(frames, [*keys, 'time_index', side])}, x array<double>, variant string")
