"""The context tree in one memory, to hold the stored tables against."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from qagrade.llm import language_model


@dataclass
class ContextTree:
    """The tree in one memory, for few contexts: what the stored tables have to give.

    step[node, byte]: the node one byte deeper, or the node's end copy; log10 of each byte."""

    depth: int
    step: np.ndarray
    logp: np.ndarray

    @staticmethod
    def of(depth: int, contexts: list[np.ndarray], counts: list[np.ndarray]) -> ContextTree:
        """`contexts[d]`: sorted contexts of `d` bytes, the nearest byte lowest; `counts[d]`: of
        the byte that followed. Every context's shorter ones have to be there."""
        base = np.concatenate([[0], np.cumsum([len(c) for c in contexts])]).astype(np.int64)
        nodes = int(base[-1])
        parent = [np.zeros(0, np.int64)]
        for d in range(1, depth + 1):
            short = contexts[d] & np.uint64((1 << 8 * (d - 1)) - 1)
            parent.append(np.searchsorted(contexts[d - 1], short))
        weighted: list[np.ndarray] = [None] * (depth + 1)
        stop: list[np.ndarray] = [None] * (depth + 1)
        rest: list[np.ndarray] = [None] * (depth + 1)
        for d in range(depth, -1, -1):
            own = language_model._decisions(counts[d].astype(np.float64))
            kt = language_model._log_kt(own)
            if d == depth or not len(contexts[d + 1]):
                weighted[d], stop[d], rest[d] = kt, np.ones_like(kt, np.float32), np.zeros_like(kt, np.float32)
                continue
            left = counts[d].astype(np.float64)
            np.subtract.at(left, parent[d + 1], counts[d + 1])
            other = language_model._decisions(left)
            split = language_model._log_kt(other)
            np.add.at(split, parent[d + 1], weighted[d + 1])
            weighted[d + 1] = None
            inner = np.bincount(parent[d + 1], minlength=len(contexts[d])) > 0
            weighted[d] = np.where(inner[:, None], np.logaddexp(kt, split) - np.log(2), kt)
            stop[d] = np.where(inner[:, None], np.exp(kt - np.log(2) - weighted[d]), 1.0).astype(np.float32)
            rest[d] = language_model._kt_one(other).astype(np.float32)
        logp = np.zeros((nodes, 256), np.float32)
        step = np.empty((2 * nodes, 256), np.int32)
        step[:] = (np.arange(2 * nodes) % nodes + nodes)[:, None]
        mixed, open_ = None, None
        values = np.arange(256)
        for d in range(depth + 1):
            p = language_model._kt_one(language_model._decisions(counts[d].astype(np.float64)))
            if d == 0:
                mixed, open_ = stop[d] * p, 1 - stop[d]
            else:
                up, still = mixed[parent[d]], open_[parent[d]]
                mixed, open_ = up + still * stop[d] * p, still * (1 - stop[d])
                last = (contexts[d] >> np.uint64(8 * (d - 1))).astype(np.int64)
                step[base[d - 1] + parent[d], last] = base[d] + np.arange(len(contexts[d]))
            one = np.clip(mixed + open_ * rest[d], 1e-12, 1 - 1e-12)
            total = np.zeros((len(one), 256))
            for k in range(8):
                at, bit = (1 << k) - 1 + (values >> (8 - k)), values >> (7 - k) & 1
                total += np.log10(np.where(bit, one[:, at], 1 - one[:, at]))
            logp[base[d] : base[d + 1]] = total
        return ContextTree(depth, step, logp)

    def log10(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """log10 probability of each text of a slice, with its end."""
        padded, places, first = language_model._padded(offsets, data, self.depth)
        node, flat = np.zeros(len(places), np.int32), self.step.ravel()
        for d in range(1, self.depth + 1):
            node = flat[node * np.int32(256) + padded[places - d]]
        nodes = len(self.logp)
        node -= np.where(node >= nodes, nodes, 0).astype(np.int32)
        each = self.logp.ravel()[node * np.int32(256) + padded[places]].astype(np.float64)
        return np.add.reduceat(each, first)
