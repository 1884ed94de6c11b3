"""Small tables with the cases every operator must take, and plain reference versions."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=1, n=60):
    """Random texts with shared passages, copies, near copies, and odd rows."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé日") for _ in range(r.randint(1, 7))) for _ in range(120)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passages = [say(r.randint(10, 70)) for _ in range(5)]
    texts = []
    for _ in range(n):
        parts = [say(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passages), say(r.randint(0, 40))]
        texts.append(r.choice([" ", "\n", "  \t"]).join(parts))
    texts += texts[:6]                                       # exact copies
    texts += [t.replace(vocab[0], vocab[1]) for t in texts[6:14]]  # near copies
    texts += ["", None, " \n\t ", "one", "two words", "three word text", "same " * 90, "ab" * 4000,
              (passages[0] + "\n") * 6, "x" * 250, "x" * 250, "   thin space", "A\u0000b " * 30]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s0", "s0", "s1", "Ω", None]), len(t or ""))
            for i, t in enumerate(texts)]
    r.shuffle(rows)
    rows += [rows[3], rows[3], (None, texts[0], None, None, 1), (None, None, None, None, None)]
    return rows


def bpe_reference(rows, path, pattern):
    import base64
    import hashlib

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = []
    for row in rows:
        text = row[1] or ""
        ids = enc.encode_ordinary(text)
        out.append((row[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(text.encode()).hexdigest()))
    return out


def byte_dedup_reference(rows, window=200):
    import hashlib

    seen = {}
    texts = [(r[1] or "").encode() for r in rows]
    for b in texts:
        for i in range(len(b) - window + 1):
            seen[b[i:i + window]] = seen.get(b[i:i + window], 0) + 1
    out = []
    for r, b in zip(rows, texts):
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((r[0], len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def word_dedup_reference(rows, window=13):
    """A null id comes after every other."""
    import hashlib

    key = lambda i: float("inf") if i is None else i
    first = {}
    split = [WORD.findall(r[1] or "") for r in rows]
    for r, w in zip(rows, split):
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            first[k] = min(first.get(k, key(r[0])), key(r[0]))
    out = []
    for r, w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < key(r[0]):
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def simhash_reference(rows, shingle=3, distance=3):
    import xxhash

    prints = []
    for r in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        w = WORD.findall(text)
        s = [" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((r[0], f"{prints[i]:016x}", min(ids, default=None)))
    return out


def measures_reference(rows):
    out = []
    for r in rows:
        text = r[1] or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        cover = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
        out.append((r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
                    len(lines) - len(set(lines)), len(cover)))
    return out


def multiset(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))
