"""The suffix tree in the memory of one process, for the small corpora of the tests."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoweave.llm.common import Tables
from chronoweave.llm.suffix_tree import END, NEXT_SEEN, PRIOR, Lookup, token_counts, tokens


def _sorted_find(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Position of each asked value in a sorted array, -1 if absent."""
    if not len(keys):
        return np.full(len(asked), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, at, -1)


class Model:
    """The whole model in the memory of one process, for small corpora: tokens with their base probabilities, and the
    states of each depth."""

    def __init__(self, keys: np.ndarray, train: np.ndarray, total: int, distinct: int):
        order = np.argsort(keys)
        self.lookup, self.count = Lookup(keys[order]), train[order]
        self.total, self.room = total, total + distinct + 1
        self.base = np.log10((self.count + 1) / self.room)
        self.end = int(self.lookup.find(np.array([END]))[0])
        self.size = np.int64(len(keys) + 1)
        self.depths: list[dict] = []

    def histories(self, ids: np.ndarray, off: np.ndarray, depth: int) -> list[np.ndarray]:
        """For d = 1..depth: the candidate context of d tokens before each token, -1 if none."""
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[off[:-1]] = self.end
        out = []
        for d in range(depth):
            level = self.depths[d]
            if d == 0:
                state = np.where(before >= 0, level["of_token"][before], -1)
            else:
                # the context of d tokens before the last one, followed by the last one
                older = np.full(len(ids), -1, np.int64)
                older[1:] = out[d - 1][:-1]
                older[off[:-1]] = -1
                state = np.full(len(ids), -1, np.int64)
                ok = np.flatnonzero((older >= 0) & (before >= 0))
                state[ok] = _sorted_find(level["grams"], older[ok] * self.size + before[ok])
            out.append(state)
        return out

    def add_depth(self, grams: np.ndarray, seen: np.ndarray) -> None:
        """Candidate contexts of one more token: sorted grams (shorter context * size + token), and their counts."""
        d = len(self.depths)
        level = {"grams": grams, "seen": seen}
        if d == 0:
            level["of_token"] = np.full(int(self.size), -1, np.int64)
            level["of_token"][grams] = np.arange(len(grams))
            level["suffix"] = np.full(len(grams), -1, np.int64)
        else:
            older, token = grams // self.size, grams % self.size
            if d == 1:
                level["suffix"] = self.depths[0]["of_token"][token]
            else:
                up = self.depths[d - 1]
                level["suffix"] = _sorted_find(up["grams"], up["suffix"][older] * self.size + token)
        self.depths.append(level)

    def chance(self, d: int, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Log10 probability of frequent tokens after contexts of depth d (0: no context)."""
        if d == 0:
            return self.base[token]
        level = self.depths[d - 1]
        out = np.empty(len(token))
        named = _sorted_find(level["next"], state * self.size + token)
        out[named >= 0] = level["next_log"][named[named >= 0]]
        rest = named < 0
        if rest.any():
            up = self.chance(d - 1, level["suffix"][state[rest]], token[rest])
            out[rest] = up + level["rest_log"][state[rest]]
        return out

    def learn(self, pairs: np.ndarray, seen: np.ndarray) -> None:
        """Distributions of the deepest contexts from sorted (context * size + token) keys and their counts."""
        level, d = self.depths[-1], len(self.depths)
        state, token = pairs // self.size, pairs % self.size
        n, total = len(level["grams"]), level["seen"].astype(float)
        up = 10 ** self.chance(d - 1, level["suffix"][state], token) if len(pairs) else np.zeros(0)
        add = lambda x: np.bincount(state, x, n).astype(float)
        named, own, suffix = add(np.ones(len(pairs))), add(seen.astype(float)), add(up)
        mle = seen / total[state]
        left, left_up = np.maximum(total - own, 0), np.maximum(1 - suffix, 1e-12)
        gain = add(seen * np.log(mle / up))
        some = left > 0
        gain[some] += left[some] * np.log(left[some] / total[some] / left_up[some])
        keep = gain > 0.5 * np.log(np.maximum(total, 2)) * np.maximum(named, 1)
        smooth = (seen + PRIOR * up) / (total[state] + PRIOR)
        rest = np.maximum(1 - add(smooth), 1e-12) / left_up
        level["rest_log"] = np.where(keep, np.log10(rest), 0.0)
        stays = keep[state]
        level["next"], level["next_log"] = pairs[stays], np.log10(smooth[stays])


def next_tokens(texts: pa.Table, model: Model, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(candidate context of ``depth``, known next token) pairs of the texts, in order, and their counts."""
    ids, off = tokens(texts["_text"])
    ids = model.lookup.find(ids)
    state = model.histories(ids, off, depth)[-1]
    ok = (state >= 0) & (ids >= 0)
    pairs, seen = np.unique(state[ok] * model.size + ids[ok], return_counts=True)
    return pairs[seen >= NEXT_SEEN], seen[seen >= NEXT_SEEN]


def train(rows: DataFrame, depth: int, least: int) -> tuple[Model, DataFrame, int]:
    """(model, counts of all tokens (key, c, t), training tokens) from rows (_text, _train), the model in memory.

    The slow twin of ``gram_weights``, which makes the same model as tables.
    """
    spark = rows.sparkSession
    counts, _, total, distinct = token_counts(rows, Tables(spark))
    held = counts.select("key", "t").toArrow()
    model = Model(held["key"].to_numpy().view(np.uint64).copy(), held["t"].to_numpy(), total, distinct)
    texts = rows.where("_train").select("_text").toArrow()
    grams = np.flatnonzero(model.count >= least).astype(np.int64)
    seen = model.count[grams]
    for d in range(1, depth + 1):
        if not len(grams):
            break
        model.add_depth(grams, seen)
        pairs, seen = next_tokens(texts, model, d)
        model.learn(pairs, seen)
        more = (seen >= least) & (pairs % model.size != model.end)
        grams, seen = pairs[more], seen[more]
    return model, counts, total
