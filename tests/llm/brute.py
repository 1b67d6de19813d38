"""Plain versions of the corpus operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import html
import math
import re
import zlib


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def held_out(doc_id: int | None, modulus: int) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % modulus == 0


def language_model(rows, scale: float, power: float) -> list[tuple]:
    tokens = [words(t) + ["</s>"] for _, t in rows]
    train = [not held_out(i, 10) for i, _ in rows]
    single, pair = collections.Counter(), collections.Counter()
    for own, learn in zip(tokens, train, strict=True):
        if learn:
            single.update(own)
            pair.update(zip(["<s>", *own], own, strict=False))
    total, types, texts = sum(single.values()), len(single), sum(train)
    out = []
    for (i, _), own, learn in zip(rows, tokens, train, strict=True):
        base = score = 0.0
        for before, word in zip(["<s>", *own], own, strict=False):
            p = (single[word] + 0.1) / (total + 0.1 * (types + 1))
            base += math.log10(p)
            seen = texts if before == "<s>" else single[before]
            if seen:
                m = scale * seen**power
                p = (pair[before, word] + m * p) / (seen + m)
            score += math.log10(p)
        out.append((i, not learn, len(own), sum(single[w] > 0 for w in own), total, round(base, 6), round(score, 6)))
    return out


def suffix_dedup(rows, window: int = 100) -> list[tuple]:
    places = collections.defaultdict(list)
    texts = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for at in range(len(t) - window + 1):
            places[t[at : at + window]].append((i, at))
    first = {k: min(v) for k, v in places.items()}
    out = []
    for (i, _), (own, t) in zip(rows, texts, strict=True):
        gone = [False] * len(t)
        for at in range(len(t) - window + 1):
            if first[t[at : at + window]] < (own, at):
                gone[at : at + window] = [True] * window
        spans = sum(g and not b for g, b in zip(gone, [False, *gone], strict=False))
        out.append((i, len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone, strict=True) if not g))))
    return out


def contamination(rows, items, window: int = 10) -> list[tuple]:
    def split(text):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text).encode())

    windows = collections.defaultdict(set)
    for item, text in items:
        own = split(text)
        width = min(window, len(own))
        for at in range(len(own) - width + 1 if own else 0):
            windows[tuple(own[at : at + width])].add("null" if item is None else str(item))
    out = []
    for i, text in rows:
        own, hit, found = split(text), set(), set()
        for width in {len(w) for w in windows}:
            for at in range(len(own) - width + 1):
                if names := windows.get(tuple(own[at : at + width])):
                    hit.update(range(at, at + width))
                    found |= names
        out.append((i, len(own), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def near_duplicates(rows) -> list[tuple]:
    sets = []
    for _, t in rows:
        own = words(t)
        sets.append({tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least: dict[int, int | None] = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = i if least.get(r) is None else min(least[r], i if i is not None else least[r])
    return [(i, len(sets[k]), i if not sets[k] else least[find(k)]) for k, (i, _) in enumerate(rows)]


def base_secrets(text: str | None) -> list[tuple]:
    text, out = text or "", []
    assign = re.compile(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out += [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out)


def secrets(rows) -> list[tuple]:
    out = []
    for i, t in rows:
        found = base_secrets(t)
        count = [sum(f[2] == k for f in found) for k in ("assign", "access", "hex")]
        out.append((i, *count, sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in found))))
    return out


def article(source: str) -> str:
    inner = re.search(r"<article>(.*)</article>", source, re.S).group(1)
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())


def hard_negatives(rows, anchors, positives: int = 5, negatives: int = 5) -> list[tuple]:
    """Rows are (id, label, integer vector) without repeats."""

    def best(own, others, most):
        scored = sorted((-sum(x * y for x, y in zip(own[2], o[2], strict=False)), o[0], k) for k, o in enumerate(others) if o[0] != own[0])
        return [(-s, i) for s, i, _ in scored[:most]]

    out = []
    for own in rows:
        if not anchors(own[0]):
            continue
        same = [o for o in rows if o[1] == own[1]]
        other = [o for o in rows if o[1] != own[1] and o[0] != own[0]]
        ranked = best(own, other, len(other))
        for score, i in best(own, same, positives):
            inside = [(s, j) for s, j in ranked if 80 * score <= 100 * s <= 100 * score]
            out += [(own[0], i, rank, j, score, s) for rank, (s, j) in enumerate(inside[:negatives], 1)]
    return out


def near_vectors(rows, link: float = 0.9) -> list[tuple]:
    """Rows are (id, vector or None)."""

    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        return math.fsum(x * y for x, y in zip(a, b, strict=False)) / math.sqrt(math.fsum(x * x for x in a)) / math.sqrt(math.fsum(y * y for y in b))

    links = {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            if usable(rows[a][1]) and usable(rows[b][1]) and cosine(rows[a][1], rows[b][1]) >= link:
                links[a].add(b)
                links[b].add(a)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, stack = {k}, [k]
        while stack:
            new = links[stack.pop()] - seen
            seen |= new
            stack += new
        least = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
        out.append((i, len(links[k]), least, i == least))
    return out


def token_alignment(rows, a_path: str, b_path: str) -> list[tuple]:
    import itertools

    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_model.encode_special_tokens = True
    # The byte-level alphabet: printable bytes are themselves, the others follow 256 in order.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    docs, holders = [], collections.Counter()
    for i, text in rows:
        source = (" " + (text or "")).encode()
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(letter[c] for c in a_model.id_to_token(k)) for k in a]
        b_bytes = [bytes([int(b_model.id_to_piece(k)[1:-1], 16)]) if b_model.is_byte(k) else b_model.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not text or b"".join(a_bytes) != source or b"".join(b_bytes) != source:
            docs.append((i, [], [], []))
            continue
        a_ends, b_ends = (list(itertools.accumulate(map(len, x))) for x in (a_bytes, b_bytes))
        groups, low, lower = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            high, higher = a_ends.index(end, low) + 1, b_ends.index(end, lower) + 1
            groups.append((a[low:high], b[lower:higher]))
            low, lower = high, higher
        docs.append((i, a, b, groups))
        holders.update({(x, y) for g, h in groups for x in g for y in h})
    best = collections.defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    out = []
    for i, a, b, groups in docs:
        links = [(x, y) for g, h in groups for x in g for y in h]
        told = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(holders[p] == best[p[0]] for p in links), sum(holders[p] for p in links), sha(told) if a else ""))
    return out
