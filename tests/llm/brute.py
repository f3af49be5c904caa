"""Plain Python versions of the queries' contracts, over rows as dicts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))


def components(nodes, pairs):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs):
    prints = [(d["doc_id"], fingerprint(d["text"])) for d in docs]
    values = sorted({f for _, f in prints})
    a = np.asarray(values, np.uint64)
    pairs = [(values[i], values[j]) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2)]
    roots = components(values, pairs)
    least = {}
    for i, f in prints:
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    return [(i, f"{f:016x}", least.get(roots[f])) for i, f in prints]


def url(u):
    if u is None or "://" not in u:
        return "", "", None, None
    rest = u[u.index("://") + 3:]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return {s: float(epochs * sizes[s]) for s in names}
        level = (budget - sum(epochs * sizes[s] for s in capped)) / sum(w[s] for s in free)
        more = {s for s in free if epochs * sizes[s] <= w[s] * level}
        if not more:
            return {s: float(epochs * sizes[s]) if s in capped else w[s] * level for s in names}
        capped |= more


def vectors(rows, least=0.98):
    fine = [r for r in rows if r["label"] is not None and r["embedding"] is not None and len(r["embedding"])
            and all(v is not None and np.isfinite(v) for v in r["embedding"]) and any(v != 0 for v in r["embedding"])]
    n, pairs = Counter(), []
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        if any(r is f for f in fine):
            groups[r["label"], len(r["embedding"])].append(k)
    for ks in groups.values():
        x = np.asarray([rows[k]["embedding"] for k in ks], np.float64)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        hit = x @ x.T >= least
        for i, j in zip(*np.nonzero(hit)):
            if i != j:
                n[ks[i]] += 1
                pairs.append((ks[i], ks[j]))
    roots = components(range(len(rows)), pairs)
    least_id = defaultdict(list)
    for k, r in enumerate(rows):
        least_id[roots[k]].append(r["vec_id"])
    out = []
    for k, r in enumerate(rows):
        ids = [i for i in least_id[roots[k]] if i is not None]
        c = min(ids) if ids else None
        out.append((r["vec_id"], n[k], c, r["vec_id"] is not None and r["vec_id"] == c))
    return out


def encode(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def crc_ids(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


ASSIGN = re.compile(r"((?:%s))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)" % "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else "_?" for c in w) for w in ("password", "passwd", "secret", "token", "api?key")))


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    base = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))
    n = Counter(k for _, _, k, _ in out)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest()


def quality(text):
    text = text or ""
    words = WORDS.findall(text)
    n = len(words)
    windows = Counter(tuple(words[i:i + 3]) for i in range(n - 2))
    cover = set()
    for i in range(n - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    seen = dup = 0
    earlier = set()
    for x in lines:
        dup += x in earlier
        earlier.add(x)
    rep = len(cover)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, rep, n < 50 or 100 * rep > 50 * n)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def dedup_lines(docs):
    """{(doc_id, text): (text left, lines with a word, lines removed)}; earlier is by doc_id, text hash, line."""
    rows = sorted({(d["doc_id"], d["text"]) for d in docs if d["text"] is not None}, key=lambda r: (
        r[0] is not None, r[0] or 0, int(np.uint64(xxhash.xxh64_intdigest(r[1].encode(), 42)).astype(np.int64))))
    seen, found, out = [], {}, {(d["doc_id"], None): (None, 0, 0) for d in docs if d["text"] is None}
    for doc, text in rows:
        left, n, gone = [], 0, 0
        for line in text.split("\n"):
            t = frozenset(WORDS.findall(line.lower()))
            if not t:
                left.append(line)
                continue
            n += 1
            near = {k for w in t for k in found.get(w, ())}
            if any(5 * len(t & seen[k]) >= 4 * len(t | seen[k]) for k in near):
                gone += 1
            else:
                left.append(line)
            for w in t:
                found.setdefault(w, set()).add(len(seen))
            seen.append(t)
        out[doc, text] = ("\n".join(left), n, gone)
    return out


def mix(docs, weights=(3, 1, 2), share=1.5, epochs=2):
    """[(doc_id, size, taken)] of rows (doc_id, source, size)."""
    sizes = Counter()
    for _, s, n in docs:
        sizes[s] += n
    target, queue = targets(sizes, weights, share, epochs), []
    order = sorted(docs, key=lambda d: (d[1] is None, (d[1] or "").encode(), hashlib.md5(
        ("mix" if d[0] is None else f"mix|{d[0]}").encode()).hexdigest(), d[0] is not None, d[0] or 0, d[2]))
    upto = Counter()
    for k, (_, s, n) in enumerate(order):
        upto[s] += n
        for e in range(epochs):
            queue.append(((upto[s] + e * sizes[s]) / target[s] if target[s] > 0 else 0.0, k, e))
    left, taken = int(share * sum(sizes.values())), Counter()
    for _, k, _ in sorted(queue):
        took = min(order[k][2], left)
        taken[k] += took
        left -= took
    return [(d[0], d[2], taken[k]) for k, d in enumerate(order)]


def most_allowed(n, risk, level):
    total, k = 0.0, -1
    for j in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(risk)
                          + (n - j) * math.log1p(-risk))
        if total > level:
            return k
        k = j
    return k


def filter_audit(docs, labels):
    """Rows (part, order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), order by order."""
    import itertools

    least = {}
    for d in docs:
        if d["doc_id"] is not None:
            t = d["text"] or ""
            least[t] = min(least.get(t, d["doc_id"]), d["doc_id"])
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and r["doc_id"] is not None}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1 and r["doc_id"] is not None}
    parts = defaultdict(list)
    for d in docs:
        t = d["text"] or ""
        words = WORDS.findall(t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": d["doc_id"] is not None and d["doc_id"] > least[t]}
        parts[d["source"] or ""].append((fails, d["doc_id"] in good, d["doc_id"] in toxic))
    out = []
    for part, rows in parts.items():
        mine, shapley = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                shapley[f] += len(gone)
                unique = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                mine.append((part, "".join(order), step, len(left), len(gone), sum(r[0][f] for r in rows) - len(gone), unique,
                             sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*m, shapley[m[1][m[2] - 1]]) for m in mine]
    return out


def vector_codes(rows, parts=16, entries=64, rounds=2):
    """Rows (vec_id, code, error, label_error, codebooks_sha256), entry by entry in plain integers."""
    kept = [r for r in rows if r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    d = max(1, -(-max([len(r["embedding"]) for r in kept], default=0) // parts))
    whole = []
    for r in kept:
        x = [max(-(1 << 25), min(1 << 25, math.floor(256 * v))) for v in r["embedding"]] + [0] * (parts * d - len(r["embedding"]))
        whole.append([x[p * d:(p + 1) * d] for p in range(parts)])
    order = sorted(range(len(kept)), key=lambda i: (kept[i]["vec_id"] is None, kept[i]["vec_id"] or 0, kept[i]["embedding"]))
    books = [[whole[i][p] for i in order[:entries]] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for x in whole:
                members[nearest(books[p], x[p])[1]].append(x[p])
            books[p] = [[sum(c) // len(members[i]) for c in zip(*members[i])] if i in members else e for i, e in enumerate(books[p])]
    found = [[nearest(books[p], x[p]) for p in range(parts)] for x in whole]
    errors = [sum(e for e, _ in f) for f in found]
    by_label = Counter()
    for r, e in zip(kept, errors):
        by_label[r["label"]] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(r["vec_id"], "".join(f"{i:02x}" for _, i in f), e, by_label[r["label"]], digest) for r, f, e in zip(kept, found, errors)]


def generalised_jaccard(a, b):
    """Sum of the lesser by sum of the greater word counts; 1 for two texts without words."""
    a, b = Counter(WORDS.findall(a)), Counter(WORDS.findall(b))
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 1.0


def in_descending_order(docs):
    """Documents by descending id, nulls last, ties by the text's hash as a signed number."""
    def signed(t):
        h = xxhash.xxh64_intdigest((t or "").encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    return sorted(docs, key=lambda d: (d["doc_id"] is None, -(d["doc_id"] or 0), signed(d["text"])))
