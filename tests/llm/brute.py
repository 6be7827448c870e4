"""Plain one-process versions of the operators' results, for comparison on small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return [w for w in re.split(f"[{SPACE}]+", text or "") if w]


def token_ids(texts, path, end_id=2):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = True
    return [np.array([*tool.encode(t or "", add_special_tokens=False).ids, end_id], "<u4") for t in texts]


def token_rows(docs, path):
    """doc_id -> (start, n_tokens, crc)"""
    docs, out, start = sorted(docs.items()), {}, 0
    for (doc, _), ids in zip(docs, token_ids([t for _, t in docs], path), strict=True):
        out[doc] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def deduplicated_lines(docs, min_docs=5, min_chars=40):
    """doc_id -> (n_lines, n_dropped, sha of the kept text)"""
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = defaultdict(set)
    for doc, text in docs.items():
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = {}
    for doc, text in docs.items():
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and doc != max(holders[key(x)]))]
        out[doc] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def near_duplicates(docs, size=4, share=80):
    """doc_id -> (n_shingles, component, kept)"""
    sets = {}
    for doc, text in docs.items():
        w = words((text or "").translate(LOWER))
        sets[doc] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    parent = {d: d for d in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(docs)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= share * large:
                both = len(sets[a] & sets[b])
                if 100 * both >= share * (small + large - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in docs}


def contaminated(docs, items, size=10):
    """doc_id -> (n_words, n_hit, n_items, sha of the items, flag)"""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in items.items():
        w = cut(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    sizes = {len(x) for x in windows}
    out = {}
    for doc, text in docs.items():
        w, hit, found = cut(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[x]
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def repeats_removed(docs, size=50):
    """doc_id -> (n_words, n_removed, sha of the kept words)"""
    first = {}
    for doc in sorted(docs):
        w = words(docs[doc])
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), doc)
    out = {}
    for doc, text in docs.items():
        w, gone = words(text), set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < doc:
                gone.update(range(i, i + size))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[doc] = (len(w), len(w) - len(kept), sha(" ".join(kept)))
    return out


def chats(rows):
    """conv_id -> (n_turns, turns sha, loss_chars, loss sha) of (conv_id, turn, role, text)"""
    grouped = defaultdict(list)
    for conv, turn, role, text in rows:
        grouped[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in grouped.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out
