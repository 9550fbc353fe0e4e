"""A plain one-row-at-a-time statement of template mining, to compare results with."""


def mine(messages, depth=4, threshold=0.4, max_children=100):
    """``messages`` are token lists. Returns keys, templates and cluster sizes."""
    children = {}  # node (tuple) -> set of child tokens
    leaves = {}  # node -> list of cluster numbers
    clusters = []  # [template, size]
    keys = []
    for tokens in messages:
        node = (len(tokens),)
        for token in tokens[: max(depth - 1, 0)]:
            here = children.setdefault(node, set())
            if token not in here:
                if "<*>" in here or len(here) >= max_children:
                    token = "<*>"
                here.add(token)
            node += (token,)
        resident = leaves.setdefault(node, [])
        scored = [(sum(a == b for a, b in zip(clusters[c][0], tokens)), -i, c) for i, c in enumerate(resident)]
        equal, _, best = max(scored, default=(-1, 0, None))
        share = equal / len(tokens) if tokens else 0.0
        if best is not None and share >= threshold:
            clusters[best][0] = [a if a == b else "<*>" for a, b in zip(clusters[best][0], tokens)]
            clusters[best][1] += 1
        else:
            best = len(clusters)
            clusters.append([list(tokens), 1])
            resident.append(best)
        keys.append(best)
    return keys, [" ".join(t) for t, _ in clusters], [n for _, n in clusters]
