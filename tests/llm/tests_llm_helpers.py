"""Brute-force versions that several tests share."""

import re

import xxhash


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """doc ids (one fingerprint each) to the smallest reachable id."""
    ids = sorted(prints)
    label = {d: d for d in ids}
    near = {d: [e for e in ids if (prints[d] ^ prints[e]).bit_count() <= 4] for d in ids}
    changed = True
    while changed:
        changed = False
        for d in ids:
            least = min(label[e] for e in near[d])
            if least < label[d]:
                label[d], changed = least, True
    return label
