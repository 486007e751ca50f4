"""Plain Python versions of the text operators, for small inputs."""

import hashlib
import re
from collections import Counter

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base_counts(text):
    text = text or ""
    w = words(text)
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(triples)
    covered = {i + k for i, g in enumerate(triples) if often[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def distance(x, y):
    """Words put in, taken out or replaced between two lists of words."""
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def near_lines(rows, least=1, words_per_edit=10):
    """rows: (doc_id, text) -> numbers of the lines of each text that go, by comparing all lines with all earlier ones."""
    seen, equal, out = [], set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate((text or "").split("\n")):
            w = tuple(words(lower(line)))
            if len(w) < least:
                continue
            bag, gone = Counter(w), w in equal
            for v, other in () if gone or len(w) < 5 else seen:
                bound = max(1, min(len(v), len(w)) // words_per_edit)
                if abs(len(v) - len(w)) <= bound and max((bag - other).total(), (other - bag).total()) <= bound and distance(v, w) <= bound:
                    gone = True
                    break
            if gone:
                out.setdefault(doc, set()).add(k)
            if w not in equal and len(w) >= 5:
                seen.append((w, bag))
            equal.add(w)
    return out


def line_dedup(rows, least=1, words_per_edit=10):
    """rows: (doc_id, text) -> texts without the lines that near_lines names."""
    gone = near_lines(rows, least, words_per_edit)
    return {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(d, ())) for d, t in rows}


def shingle_set(text, n):
    w = words(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(rows, n, num, den):
    sets = {d: shingle_set(t, n) for d, t in rows}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            same = len(sets[a] & sets[b])
            if same and den * same >= num * (len(sets[a]) + len(sets[b]) - same):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def hits(text, items, length=10):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]
    w, hit, found = split(text), set(), set()
    for item, said in items:
        v = split(said)
        m = min(len(v), length)
        wins = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if v else set()
        for i in range(len(w) - m + 1) if v else ():
            if tuple(w[i : i + m]) in wins:
                hit.update(range(i, i + m))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def repeated_bytes(rows, length):
    """rows: (key, bytes) -> kept bytes and number of removed runs."""
    often = Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    out = {}
    for key, b in rows:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if often[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (bytes(x for x, g in zip(b, gone, strict=True) if not g), runs)
    return out
