"""Plain versions of the contracts, for small tables."""

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, cap=2):
    """Shares the total again and again until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        unit = left / sum(w[s] for s in free)
        full = {s for s in free if unit * w[s] > cap * sizes[s]}
        if not full:
            out |= {s: unit * w[s] for s in free}
            break
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= full
    return out


def secrets(text):
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
    count = [sum(k == x[2] for x in spans) for k in ("assign", "access", "hex")]
    return (*count, hashlib.sha256(joined.encode()).hexdigest())


def crc(text):
    return zlib.crc32((text or "").encode())
