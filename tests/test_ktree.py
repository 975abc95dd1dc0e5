"""The K-tree's kernel against a plain sequential model that keeps no counts and looks at all objects each time."""

import random

import numpy as np
import pytest

from arborsig.operators.ktree import KTreeKernel


class Plain:
    """A node is [is_leaf, [(key, child or name)]]; counts and keys are worked out from the objects below, one by one."""

    def __init__(self, order, delay, seed):
        self.order, self.delay, self.rng, self.root, self.added = order, delay, random.Random(seed), [True, []], 0

    def objects(self, node):
        return len(node[1]) if node[0] else sum(self.objects(c) for _, c in node[1])

    def centre(self, node):
        weights = [1 if node[0] else self.objects(c) for _, c in node[1]]
        bits = [sum(w for w, (k, _) in zip(weights, node[1]) if k >> i & 1) for i in range(64)]
        return sum(1 << i for i, b in enumerate(bits) if 2 * b > sum(weights))

    def halves(self, node):
        entries = node[1]
        keys = [entries[i][0] for i in self.rng.sample(range(len(entries)), 2)]
        for _ in range(2):
            sides = [[], []]
            for i, (k, _) in enumerate(entries):
                sides[(k ^ keys[1]).bit_count() < (k ^ keys[0]).bit_count()].append(i)
            if not all(sides):
                mixed = self.rng.sample(range(len(entries)), len(entries))
                sides = [sorted(mixed[: len(mixed) // 2]), sorted(mixed[len(mixed) // 2 :])]
                break
            keys = [self.centre([True, [entries[i] for i in s]]) for s in sides]
        return [[node[0], [entries[i] for i in s]] for s in sides]

    def push(self, node, name, key):
        if node[0]:
            node[1].append((key, name))
        else:
            near = [(k ^ key).bit_count() for k, _ in node[1]]
            i = near.index(min(near))
            parts = self.push(node[1][i][1], name, key)
            if parts:
                node[1][i : i + 1] = [(self.centre(p), p) for p in parts]
            elif self.added % self.delay == 0:
                node[1][i] = (self.centre(node[1][i][1]), node[1][i][1])
        return self.halves(node) if len(node[1]) > self.order else None

    def add(self, name, key):
        parts = self.push(self.root, name, key)
        if parts:
            self.root = [False, [(self.centre(p), p) for p in parts]]
        self.added += 1

    def members(self, node, at):
        if node[0]:
            return [(n, at) for _, n in node[1]]
        return [m for i, (_, c) in enumerate(node[1]) for m in self.members(c, f"{at}.{i}")]

    def keys(self, node, at):
        return [] if node[0] else [x for i, (k, c) in enumerate(node[1]) for x in [(f"{at}.{i}", k), *self.keys(c, f"{at}.{i}")]]


@pytest.mark.parametrize("order, delay", [(2, 1), (4, 1), (5, 7), (10, 50)])
def test_kernel_equals_the_sequential_model(order, delay):
    r = random.Random(order)
    values = [r.getrandbits(63) for _ in range(220)] + [5] * 12  # with copies
    kernel, plain = KTreeKernel(order, delay=delay, seed=3), Plain(order, delay, 3)
    for i, v in enumerate(values):
        kernel.add(i, (v,))
        plain.add(i, v)
    keys, members = kernel.rows("r")
    assert members == plain.members(plain.root, "r")
    assert [(k[0], int(np.uint64(np.int64(k[4][0])))) for k in keys] == plain.keys(plain.root, "r")
    assert kernel.root.count == len(values)
