"""Plain versions of the text operators for small inputs."""

import re

SPACE = "[\x20\x09-\x0D]+"


def shingle_set(text, width):
    words = [w for w in re.split(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k:k + width]) for k in range(len(words) - width + 1))


class Forest:
    """Union-find that names a set by its smallest member."""

    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def root(self, n):
        while self.up[n] != n:
            self.up[n] = self.up[self.up[n]]
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def components(nodes, linked):
    nodes = list(nodes)
    f = Forest(nodes)
    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if linked(a, b):
                f.join(a, b)
    return {n: f.root(n) for n in nodes}


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
