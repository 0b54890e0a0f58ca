"""Plain versions of the operators for small tables; each follows its contract row by row."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def words(text):
    return [] if text is None else text.encode().split()


class Forest(dict):
    def find(self, a):
        self.setdefault(a, a)
        while self[a] != a:
            a = self[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def substrings(rows, window=13):
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            f = first.get(tuple(w[i : i + window]))
            if f is not None and (doc is None or f < doc):
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def jaccard(rows, n=5, percent=80):
    sets = []
    for doc, text in rows:
        w = [] if text is None else text.encode().lower().split()
        k = min(n, len(w))
        sets.append((doc, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()))
    lists = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            lists[x].append(k)
    pairs = {(a, b) for m in lists.values() for i, a in enumerate(m) for b in m[i + 1 :]}
    forest = Forest()
    for a, b in pairs:
        s, t = sets[a][1], sets[b][1]
        if 100 * len(s & t) >= percent * len(s | t):
            forest.join(sets[a][0], sets[b][0])
    return {doc: (len(s), forest.find(doc)) for doc, s in sets}


def vectors(rows, least=0.93):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    forest, n = Forest(), defaultdict(int)
    for a in range(len(good)):
        for b in range(a):
            if good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]):
                x, y = good[a][1], good[b][1]
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    forest.join(good[a][0], good[b][0])
                    n[good[a][0]] += 1
                    n[good[b][0]] += 1
    return {i: (n[i], forest.find(i)) for i, _, _ in rows}


def top(rows, every=50, k=5):
    good = [(i, [int(np.floor(256.0 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, a in good:
        if q % every == 0:
            scored = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q))[:k]
            for r, (s, i) in enumerate(scored):
                out[q, r + 1] = (i, -s)
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Source to target words: share by weight, cut at the cap, reshare the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > most * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / whole for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def pieces(rows, tokenizer, capacity=2048):
    out = {}
    for doc, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out[doc, k] = (at, len(part), zlib.crc32(part.tobytes()))
    return out


def splits(name):
    """Every way to cut a string into parts."""
    if not name:
        yield []
    for k in range(1, len(name) + 1):
        for rest in splits(name[k:]):
            yield [name[:k], *rest]


def _cheapest(name, counts):
    """Least cost and the split, by a plain recursion over prefixes, tried from the shortest first word on."""
    total = sum(counts.values())
    best = [(0.0, [])]
    for end in range(1, len(name) + 1):
        found = []
        # an unknown word may have any length, but two of them in a row cost more than one
        for begin in range(max(0, end - 60), end) if len(name) < 200 else range(max(0, end - 24), end):
            w = name[begin:end]
            cost = math.log(total / counts[w]) if counts.get(w) else math.log(total) + 1 + math.log(10) * len(w)
            found.append((best[begin][0] + cost, best[begin][1] + [w] if len(name) < 200 else None, begin))
        low = min(f[0] for f in found)
        best.append(next((f[0], f[1]) if f[1] is not None else (f[0], f[2]) for f in found if f[0] <= low + 1e-9))
    if len(name) < 200:
        return best[-1][1]
    out, end = [], len(name)
    while end:
        out.append(name[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def urls(data, texts, rules, block_words, allow_words):
    """host, path, rule, verdict of each url; the whole rule by plain loops."""
    lists = Counter([*block_words, *allow_words])
    learned = Counter(w for t in texts if t for w in re.findall("[a-z]+", t.lower()) if 2 <= len(w) <= 24)
    each = max(1, sum(learned.values()) / sum(lists.values()))
    unigrams = {w: learned[w] + each * lists[w] for w in {*learned, *lists} if len(w) > 1}

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url[url.index("://") + 3 :]
        at = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        path = rest[at:]
        return rest[:at].lower(), path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]

    def fit(host, path):
        found = [(len(h + p), -k) for k, (h, p, _) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return rules[-max(found)[1]] if found else None

    def tokens(host, path):
        labels = host.split(":")[0].split(".")
        name = labels[:-1] if len(labels) > 1 else labels
        return [w for r in re.findall("[a-z]+", " ".join(name)) + re.findall("[a-z]+", path.lower()) for w in _cheapest(r, unigrams) if len(w) > 1]

    every = [parts(u) for u in data]
    seen = {"block": Counter(), "allow": Counter()}
    for host, path in every:
        if rule := fit(host, path):
            # what the rule itself is made of teaches nothing; "x" stands for the last label
            rest = host.removesuffix(rule[0]).rstrip(".")
            seen[rule[2]].update(tokens(rest + ".x" if rest else "", path.removeprefix(rule[1])))
    model = {}
    for name, words in (("block", block_words), ("allow", allow_words)):
        mass = max(*(sum(c.values()) for c in seen.values()), len(block_words), len(allow_words))
        scale = mass / max(1, sum(seen[name].values()))
        model[name] = {w: scale * seen[name][w] + mass / len(words) * words.count(w) for w in {*seen[name], *words}}
    vocabulary = {*model["block"], *model["allow"]}
    rate = {n: {w: (m.get(w, 0) + 1) / (sum(m.values()) + len(vocabulary)) for w in vocabulary} for n, m in model.items()}
    out = []
    for host, path in every:
        rule = fit(host, path)
        if rule:
            out.append((host, path, rule[0] + rule[1], rule[2]))
            continue
        known = [t for t in tokens(host, path) if t in vocabulary]
        odds = math.log(0.3 / 0.7) + sum(math.log(rate["block"][t] / rate["allow"][t]) for t in known)
        out.append((host, path, None, "block" if known and odds > 0 else "allow"))
    return out


BLOCKS = {"p", "div", "section", "ul", "li", "article", "main", "h1", "br"}
DROPS = {"nav", "header", "footer", "aside", "form"}


def page_html(node):
    """Markup of a tree of (tag, attributes, children) and strings."""
    if isinstance(node, str):
        return node.replace("&", "&amp;").replace("<", "&lt;")
    tag, attributes, children = node
    return f"<{tag}{attributes}>" + "" .join(map(page_html, children)) + ("" if tag == "br" else f"</{tag}>")


def page_text(root, stop_words, names):
    """The text that both passes keep, from the tree itself."""
    blocks, current, homes = [], [], {0: False}

    def cut():
        if current and "".join(t for t, *_ in current).strip():
            text = " ".join("".join(t for t, *_ in current).split())
            linked = sum(len(t) for t, link, *_ in current if link) > 0.5 * sum(len(t) for t, *_ in current)
            blocks.append({"text": text, "drop": current[0][2], "home": current[0][3], "links": linked})
        current.clear()

    def walk(node, drop, home, link):
        if isinstance(node, str):
            current.append((node, link, drop, home))
            return
        tag, attributes, children = node
        mine = tag in DROPS or (tag not in ("article", "main") and any(f'class="{n}"' in attributes for n in names)) or attributes in (" hidden", ' style="display: none"')
        edge = tag in BLOCKS or tag in DROPS or mine
        if edge:
            cut()
        if tag in ("article", "main") and not drop and not mine:
            home = len(homes)
            homes[home] = True
        for c in children:
            walk(c, drop or mine, home, link or tag == "a")
        if edge:
            cut()

    walk(root, False, 0, False)
    cut()
    share = {}
    for k, b in enumerate(blocks):
        b["label"] = False if b["drop"] or b["links"] else None
        if b["label"] is None and len(b["text"]) >= 70:
            found = re.findall(r"[^\W\d_]+", b["text"].lower())
            share[k] = sum(w in stop_words for w in found) / max(1, len(found))
    known = any(x >= 0.15 for x in share.values())
    for k, x in share.items():
        b = blocks[k]
        latin = sum(c < "\u0250" for c in b["text"] if c.isalpha()) * 2 >= sum(c.isalpha() for c in b["text"])
        if x >= 0.15:
            b["label"] = True
        elif not known or not latin:
            b["label"] = True if re.search("[.!?。]", b["text"]) else None
        elif x < 0.05 and not homes[b["home"]]:
            b["label"], b["weak"] = False, True
    for home in homes:
        mine = [b for b in blocks if b["home"] == home and b["label"] is not None and not b["drop"]]
        for i, b in enumerate(mine):
            left = next((x["label"] for x in mine[:i][::-1] if "weak" not in x), False)
            right = next((x["label"] for x in mine[i + 1 :] if "weak" not in x), False)
            if "weak" in b and left and right:
                b["label"] = True
    sure = [b["label"] for b in blocks]
    for home in homes:
        mine = [k for k, b in enumerate(blocks) if b["home"] == home]
        decided = [i for i, k in enumerate(mine) if sure[k] is not None and not blocks[k]["drop"]]
        for i, k in enumerate(mine):
            if sure[k] is None:
                if not decided:
                    blocks[k]["label"] = homes[home] or not any(homes.values())
                    continue
                near = min(abs(i - j) for j in decided)
                labels = [sure[mine[j]] for j in decided if abs(i - j) == near]
                blocks[k]["label"] = any(labels) if homes[home] else all(labels)
    kept = [b for b in blocks if b["label"]]
    if names and not kept and any(len(b["text"]) >= 70 for b in blocks):
        return page_text(root, stop_words, ())
    inside = [b["text"] for b in kept if homes[b["home"]]]
    return " ".join(inside or [b["text"] for b in kept])
