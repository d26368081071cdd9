"""Plain-Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter


def fold(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text):
    w = space_words(fold(text))
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def near_duplicates(rows):
    """[(id, text)] -> [(id, n_shingles, component_id)], row by row."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((key, len(sets[i]), (min(ids, default=None) if sets[i] else key)))
    return out


BASE_LICENSES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))


def license_base(text):
    w, places, labels = alnum_words(text), [], set()
    for label, phrase in BASE_LICENSES:
        k = phrase.split()
        for i in range(len(w) - len(k) + 1):
            if w[i : i + len(k)] == k:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def quality_base(text):
    text = text or ""
    w = space_words(text)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = Counter(line for line in text.split("\n") if space_words(line))
    dup = sum(n - 1 for n in lines.values())
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_base(text):
    found = []
    for order, (kind, pattern) in enumerate(PII):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 12 <= len(d) <= 19 and luhn(d) if d else False,
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                found.append((m.start(), order, m.end(), kind))
    return sorted(found)


def pii_row(text):
    found = pii_base(text)
    listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
    return (*(sum(f[3] == k for f in found) for k, _ in PII), hashlib.sha256(listed.encode()).hexdigest())


def contamination(text, items):
    w, hit, met = alnum_words(text), set(), set()
    for item, body in items:
        b = alnum_words(body)
        k = min(13, len(b))
        for j in range(len(b) - k + 1 if b else 0):
            for i in range(len(w) - k + 1):
                if w[i : i + k] == b[j : j + k]:
                    hit.update(range(i, i + k))
                    met.add(item)
    digest = hashlib.sha256(",".join(sorted(map(str, met))).encode()).hexdigest()
    return len(w), len(hit), len(met), digest, len(hit) > 0 and 20 * len(hit) >= len(w)


RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def url_parts(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = fold(host)
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    name, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
    return host, path, name, verdict
