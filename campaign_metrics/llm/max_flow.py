"""Binary labelling of least cost by a minimum cut, exact, with integer capacities.

Cost: a node labelled False pays its positive score, a node labelled True pays its negated negative score, and every edge
between unlike labels pays its weight.
"""

from __future__ import annotations

from collections import deque


def _settle(scores: list[int], near: list[dict[int, int]]) -> list[bool | None]:
    """Label nodes whose score outweighs all their open edges, folding those edges into the neighbours' scores.

    Such a node has the same label in some least-cost labelling whatever its neighbours get.
    """
    labels: list[bool | None] = [None] * len(scores)
    weight = [sum(n.values()) for n in near]
    queue = deque(range(len(scores)))
    while queue:
        i = queue.popleft()
        if labels[i] is not None or abs(scores[i]) < weight[i]:
            continue
        labels[i] = scores[i] > 0
        for j, w in near[i].items():
            if labels[j] is None:
                scores[j] += w if labels[i] else -w
                weight[j] -= w
                queue.append(j)
    return labels


def _reached(n: int, graph: list[dict[int, int]], source: int, sink: int) -> tuple[list[int], bool]:
    level = [-1] * n
    level[source] = 0
    queue = deque([source])
    while queue:
        u = queue.popleft()
        for v, c in graph[u].items():
            if c > 0 and level[v] < 0:
                level[v] = level[u] + 1
                queue.append(v)
    return level, level[sink] >= 0


def _blocking_flow(graph: list[dict[int, int]], level: list[int], source: int, sink: int) -> None:
    """Saturate the level graph by depth-first augmenting paths (no recursion)."""
    arcs = [list(g) for g in graph]
    path = [source]
    while path:
        u = path[-1]
        if u == sink:
            flow = min(graph[a][b] for a, b in zip(path, path[1:]))
            cut = None
            for k, (a, b) in enumerate(zip(path, path[1:])):
                graph[a][b] -= flow
                graph[b][a] += flow
                if cut is None and not graph[a][b]:
                    cut = k
            path = path[:cut + 1]
            continue
        while arcs[u]:
            v = arcs[u][-1]
            if graph[u][v] > 0 and level[v] == level[u] + 1:
                path.append(v)
                break
            arcs[u].pop()
        else:
            path.pop()
            if path:
                arcs[path[-1]].pop()


def least_cost_labels(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of least total cost; ties go to False."""
    n = len(scores)
    scores = list(scores)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0) + w
            near[j][i] = near[j].get(i, 0) + w
    labels = _settle(scores, near)
    open_ = [i for i in range(n) if labels[i] is None]
    if open_:  # Dinic's algorithm on what is left
        place = {i: k for k, i in enumerate(open_)}
        source, sink = len(open_), len(open_) + 1
        graph: list[dict[int, int]] = [{} for _ in range(len(open_) + 2)]
        for i, k in place.items():
            graph[source][k], graph[k][source] = max(0, scores[i]), 0
            graph[k][sink], graph[sink][k] = max(0, -scores[i]), 0
            for j, w in near[i].items():
                if j in place:
                    graph[k][place[j]] = w
        while True:
            level, more = _reached(len(graph), graph, source, sink)
            if not more:
                break
            _blocking_flow(graph, level, source, sink)
        for i, k in place.items():
            labels[i] = level[k] >= 0
    return [bool(x) for x in labels]


def labelling_cost(scores: list[int], edges: list[tuple[int, int, int]], labels: list[bool]) -> int:
    unary = sum(max(0, -s) if x else max(0, s) for s, x in zip(scores, labels))
    return unary + sum(w for i, j, w in edges if w > 0 and labels[i] != labels[j])
