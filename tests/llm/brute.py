"""Plain versions of the training-data operators, row by row, as the tests' yardstick."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return SPACE.findall(text or "")


def tokens(docs, tokenizer, end=2):
    """{doc_id: (start, n_tokens, crc)}; docs: (doc_id, text)."""
    out, start = {}, 0
    for i, text in sorted(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out[i] = (start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        start += len(ids)
    return out


def repeats(texts, window=35):
    """[(n_words, n_removed, digest)] of texts in order."""
    rows = [words(t) for t in texts]
    seen = Counter(tuple(r[i:i + window]) for r in rows for i in range(len(r) - window + 1))
    out = []
    for r in rows:
        gone = set()
        for i in range(len(r) - window + 1):
            if seen[tuple(r[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(r), len(gone), sha(" ".join(w for i, w in enumerate(r) if i not in gone))))
    return out


# The base patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    """[(kind, start, end)] of the base kinds, by start, then kind."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def base_figures(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    own = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    threes = Counter(tuple(own[i:i + 3]) for i in range(len(own) - 2))
    again = {j for i in range(len(own) - 2) if threes[tuple(own[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again),
            len(own) < 50 or 100 * len(again) > 50 * len(own))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(docs, items, window=13):
    """{doc_id: (n_words, n_hit, n_items, digest, contaminated)}."""
    windows = defaultdict(set)
    for item, text in items:
        own = terms(text)
        n = min(window, len(own))
        if n:
            for i in range(len(own) - n + 1):
                windows[tuple(own[i:i + n])].add(str(item))
    sizes = sorted({len(w) for w in windows})
    out = {}
    for i, text in docs:
        own, hit, found = terms(text), set(), set()
        for n in sizes:
            for j in range(len(own) - n + 1):
                if (w := tuple(own[j:j + n])) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[w]
        out[i] = (len(own), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(own))
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    """{source: target}; sizes: {source or None: words}."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while open_ and left > 1e-9:
        whole, over = sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += left * weight[s] / whole
        for s in list(open_):
            if target[s] >= repeats * sizes[s]:
                over += target[s] - repeats * sizes[s]
                target[s] = float(repeats * sizes[s])
                open_.discard(s)
        left = over
    return target


def fingerprint(text):
    own = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    own = words(own)
    shingles = [" ".join(own[i:i + 4]) for i in range(len(own) - 3)] or ([" ".join(own)] if own else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(points, distance=4):
    """{id: (hex fingerprint, smallest id of the class)}; points: {id: fingerprint}."""
    root = {i: i for i in points}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ids = sorted(points)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            if (points[i] ^ points[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (f"{points[i]:016x}", find(i)) for i in ids}


def chats(rows, learned="assistant"):
    """{conv_id: (n_turns, turns digest, loss_chars, loss digest)}; rows: (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == learned)
        out[conv] = (len(turns), sha(said), len(loss), sha(loss))
    return out


def alignment(texts, a_file, b_file):
    """[(n_a, n_b, n_groups, n_links, n_best, count_sum, digest)] of texts in order, from whole texts and all interval pairs."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    a, b = Tokenizer.from_file(a_file), SentencePieceProcessor(model_file=b_file)
    a.encode_special_tokens = True
    latin = {c: ord(c) for c in map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)])}
    letters = latin | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in latin.values())}
    assert decoders.ByteLevel().decode(["Ġé"]) == " �"
    docs = []
    for text in texts:
        ids, raw = ([], []), b" " + (text or "").encode()
        if text:
            own = a.encode(" " + text, add_special_tokens=False)
            ids = own.ids, b.encode(text)
        shown = ([bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]],
                 [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids[1] for p in [b.id_to_piece(i)]])
        if not text or any(b"".join(s) != raw for s in shown):
            docs.append(None)
            continue
        spans = []
        for side in shown:
            at, own = 0, []
            for s in side:
                own.append((at, at + len(s)))
                at += len(s)
            spans.append(own)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, begin = [], 0
        for cut in cuts:
            groups.append([[i for i, (s, e) in zip(ids[k], spans[k], strict=True) if begin <= s and e <= cut] for k in (0, 1)])
            begin = cut
        links = [(ids[0][i], ids[1][j]) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
        digest = sha(";".join("|".join(",".join(map(str, side)) for side in g) for g in groups))
        docs.append((len(ids[0]), len(ids[1]), len(groups), links, digest))
    counts = Counter(p for d in docs if d for p in set(d[3]))
    top = Counter()
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return [(*d[:3], len(d[3]), sum(counts[p] == top[p[0]] for p in d[3]), sum(counts[p] for p in d[3]), d[4]) if d else (0,) * 6 + ("",)
            for d in docs]


def archived(pages):
    """Sorted [(page_id, bytes, digest, type, refers_to)]; pages: (page_id, html)."""
    first = {}
    for i, html in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, html in pages:
        raw, least = (html or "").encode(), first.get(html or "")
        again = len(raw) >= 100 and least is not None and least != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", least if again else None))
    return out


def phrases(docs, least=30, top=2000):
    """{(lang, rank): (phrase, a, l, r, n, score)}; docs: (lang, text)."""
    n, f = Counter(), Counter()
    for lang, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            own = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(own)
            for k in range(1, 5):
                f.update(("und" if lang is None else lang, tuple(own[i:i + k])) for i in range(len(own) - k + 1))
    found = defaultdict(list)
    candidates = [(lang, w) for (lang, w), a in f.items() if len(w) > 1 and a >= least]
    around = Counter()
    for lang, w in candidates:
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                around[lang, w[i:i + k]] = max(around[lang, w[i:i + k]], f[lang, w])
    for lang, w in candidates:
        a = f[lang, w]
        if 100 * around[lang, w] >= 80 * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        found[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, rank): (p.decode(), -a, left, right, n[lang], -s)
            for lang, rows in found.items() for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}
