"""SQL text for checking the core's queries: signatures, k-means rounds, trees and descents as chains of CTEs.

Each engine step has a function here that writes it in plain SQL, by other means than the engine uses.
"""

from __future__ import annotations

from collections.abc import Callable


def place(i: int) -> str:
    return "(-9223372036854775807 - 1)" if i == 63 else str(1 << i)


def pack(flag: Callable[[int], str], bits: int = 64) -> str:
    return "CAST(" + " + ".join(f"(CASE WHEN {flag(i)} THEN {place(i)} ELSE 0 END)" for i in range(bits)) + " AS BIGINT)"


def bit(i: int, s: str = "sig") -> str:
    return f"(({s} >> {i}) & 1)"


def majority(s: str = "sig", w: str = "1", bits: int = 64) -> str:
    return pack(lambda i: f"2 * sum({bit(i, s)} * {w}) > sum({w})", bits)


SIGS = "sigs AS (SELECT vec_id AS id, label, " + pack(lambda i: f"embedding[{i + 1}] > 0") + " AS sig FROM embeddings)"
ORDER = "md5('42:' || CAST(id AS VARCHAR)), id"


def hamming(a: str, b: str) -> str:
    return f"CAST(bit_count(xor({a}, {b})) AS BIGINT)"


def assign(name: str, objs: str, keys: str) -> list[str]:
    """name (id, sig, g, idx, dist): the nearest key of each object's group, the lowest number on ties."""
    return [
        f"{name}_p AS (SELECT o.id, o.sig, o.g, min({hamming('o.sig', 'k.sig')} * 4294967296 + k.idx) AS packed FROM {objs} o JOIN {keys} k ON o.g = k.g GROUP BY o.id, o.sig, o.g)",
        f"{name} AS (SELECT id, sig, g, packed % 4294967296 AS idx, packed // 4294967296 AS dist FROM {name}_p)",
    ]


def kmeans(p: str, objs: str, k: int, iters: int) -> list[str]:
    """p_a (id, sig, g, idx, dist) and p_k (g, idx, sig)."""
    out = [f"{p}_k0 AS (SELECT g, idx, sig FROM (SELECT g, sig, row_number() OVER (PARTITION BY g ORDER BY {ORDER}) - 1 AS idx FROM {objs}) WHERE idx < {k})", *assign(f"{p}_a0", objs, f"{p}_k0")]
    for t in range(1, iters + 1):
        out += [f"{p}_m{t} AS (SELECT g, idx, {majority()} AS sig FROM {p}_a{t - 1} GROUP BY g, idx)", f"{p}_k{t} AS (SELECT k.g, k.idx, coalesce(m.sig, k.sig) AS sig FROM {p}_k{t - 1} k LEFT JOIN {p}_m{t} m ON k.g = m.g AND k.idx = m.idx)"]
        if t < iters:
            out += assign(f"{p}_a{t}", objs, f"{p}_k{t}")
    last = max(0, iters - 1)
    return out + [f"{p}_a AS (SELECT * FROM {p}_a{last})", f"{p}_k AS (SELECT k.* FROM {p}_k{iters} k WHERE EXISTS (SELECT 1 FROM {p}_a a WHERE a.g = k.g AND a.idx = k.idx))"]


def split(p: str, objs: str, fan_outs: list[int], iters: int) -> list[str]:
    """p_leaf (id, sig, leaf_id) and p_nodes (node_id, parent_id, level, idx, sig)."""
    out = [f"{p}_o1 AS (SELECT id, sig, 'r' AS g FROM {objs})"]
    for n, m in enumerate(fan_outs, 1):
        out += kmeans(f"{p}_l{n}", f"{p}_o{n}", m, iters)
        out.append(f"{p}_o{n + 1} AS (SELECT id, sig, g || '.' || idx AS g FROM {p}_l{n}_a)")
    nodes = " UNION ALL ".join(f"SELECT g || '.' || idx AS node_id, g AS parent_id, {n} AS level, idx, sig FROM {p}_l{n}_k" for n in range(1, len(fan_outs) + 1))
    return out + [f"{p}_nodes AS ({nodes})", f"{p}_leaf AS (SELECT id, sig, g AS leaf_id FROM {p}_o{len(fan_outs) + 1})"]


def descend(p: str, objs: str, nodes: str, levels: int) -> list[str]:
    """p_path (level, id, sig, node_id, dist) and p_leaf (id, sig, leaf_id, dist)."""
    out = [f"{p}_d0 AS (SELECT id, sig, 'r' AS g FROM {objs})"]
    for n in range(1, levels + 1):
        out.append(f"{p}_c{n} AS (SELECT parent_id AS g, idx, sig FROM {nodes} WHERE level = {n})")
        out += assign(f"{p}_n{n}", f"{p}_d{n - 1}", f"{p}_c{n}")
        out.append(f"{p}_d{n} AS (SELECT id, sig, g || '.' || idx AS g, dist FROM {p}_n{n})")
    path = " UNION ALL ".join(f"SELECT {n} AS level, id, sig, g AS node_id, dist FROM {p}_d{n}" for n in range(1, levels + 1))
    return out + [f"{p}_path AS ({path})", f"{p}_leaf AS (SELECT id, sig, g AS leaf_id, dist FROM {p}_d{levels})"]


def up(node: str, level: int, levels: int) -> str:
    """The ancestor at a level of a leaf id."""
    return f"array_to_string(string_split({node}, '.')[1:{level + 1}], '.')" if level < levels else node


def rolled(p: str, leaf: str, nodes: str, levels: int) -> list[str]:
    """p_nodes: each key the majority of all objects below it; keys without objects stay."""
    every = " UNION ALL ".join(f"SELECT {up('leaf_id', n, levels)} AS node_id, sig FROM {leaf}" for n in range(1, levels + 1))
    return [f"{p}_m AS (SELECT node_id, {majority()} AS sig FROM ({every}) GROUP BY node_id)", f"{p}_nodes AS (SELECT n.node_id, n.parent_id, n.level, n.idx, coalesce(m.sig, n.sig) AS sig FROM {nodes} n LEFT JOIN {p}_m m ON n.node_id = m.node_id)"]


def pruned(p: str, leaf: str, nodes: str, levels: int) -> list[str]:
    """p_nodes: the keys with objects below."""
    every = " UNION ".join(f"SELECT {up('leaf_id', n, levels)} AS node_id FROM {leaf}" for n in range(1, levels + 1))
    return [f"{p}_nodes AS (SELECT n.* FROM {nodes} n WHERE n.node_id IN (SELECT node_id FROM ({every})))"]


def rebuilt(p: str, leaf: str, nodes: str, levels: int) -> list[str]:
    """p_nodes: leaves' keys the majority of their objects, others' that of their children's keys by weight."""
    out = [f"{p}_v{levels} AS (SELECT leaf_id AS node_id, {majority()} AS sig, count(*) AS n FROM {leaf} GROUP BY leaf_id)"]
    for n in range(levels - 1, 0, -1):
        parent = f"array_to_string(string_split(node_id, '.')[1:{n + 1}], '.')"
        out.append(f"{p}_v{n} AS (SELECT {parent} AS node_id, {majority(w='n')} AS sig, CAST(sum(n) AS BIGINT) AS n FROM {p}_v{n + 1} GROUP BY {parent})")
    every = " UNION ALL ".join(f"SELECT node_id, sig FROM {p}_v{n}" for n in range(1, levels + 1))
    return out + [f"{p}_nodes AS (SELECT n.node_id, n.parent_id, n.level, n.idx, coalesce(v.sig, n.sig) AS sig FROM {nodes} n LEFT JOIN ({every}) v ON n.node_id = v.node_id)"]


def query(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n ".join(ctes) + "\n" + select
