"""Plain searches that several tests share."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def roots_of(values, linked):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    ordered = sorted(parent)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if linked(a, b):
                parent[find(a)] = find(b)
    return {v: find(v) for v in values}


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def cut_windows(texts, items, window=10):
    """Texts without the words in any window of an item, nor what stands between those of one span."""
    phrases = set()
    for t in items:
        w = WORD.findall(lowered(t))
        phrases |= {tuple(w[k : k + window]) for k in range(max(len(w) - window, 0) + 1)} if w else set()
    lengths = {len(p) for p in phrases}
    out = {}
    for i, t in texts.items():
        places = [m.span() for m in WORD.finditer(lowered(t))]
        w = [lowered(t)[a:b] for a, b in places]
        hit = sorted({k + j for n in lengths for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in phrases for j in range(n)})
        pieces, at = [], 0
        for j in hit:
            if j - 1 not in hit:
                pieces.append(t[at : places[j][0]])
            at = places[j][1]
        out[i] = "".join([*pieces, t[at:]]) if hit else t
    return out


def base_spans_masked(text):
    """The text, if no base kind is in it; otherwise only a text with a mask can be right."""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    found = any(len(m[2]) >= 12 for m in assign.finditer(text)) or re.search(r"AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", text)
    return None if found else text
