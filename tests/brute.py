"""Plain Python versions of the general problems over lists of rows, for comparison."""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from datetime import datetime
from fractions import Fraction


def norm(i):
    """By parts: the last place where four numbers follow each other, with a path before it and lines from 1 on."""
    s = i.replace("\\", "/")
    parts = s.split(":")
    for k in range(len(parts) - 4, 0, -1):
        four = parts[k : k + 4]
        if all(re.fullmatch("[0-9]+", x) for x in four):
            path = ":".join(parts[:k])
            if not path or int(four[0]) < 1 or int(four[2]) < 1:
                return s
            return ":".join([path, *(str(int(x)) for x in four)])
    return s


def runs(prov):
    ws = defaultdict(list)
    for p in prov:
        m = json.loads(p["metadata_json"])
        ws[m["workspace"]].append((datetime.fromisoformat(m["extracted_at"].replace("Z", "+00:00")), p["id"]))
    return {w: [i for _, i in sorted(v)] for w, v in ws.items()}


def canon(v):
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, float)):
        return ("n", Fraction(v))
    if isinstance(v, str):
        return ("s", v)
    if isinstance(v, list):
        return ("l", tuple(map(canon, v)))
    if v is None:
        return ("0",)
    return ("o", tuple(sorted((k, canon(x)) for k, x in v.items() if x is not None)))


def jtype(v):
    return {bool: "boolean", int: "number", float: "number", str: "string", list: "list", dict: "object"}.get(type(v))


def merged(entities):
    """(run, id) -> (labels, props, kind)"""
    out = {}
    for r in sorted(entities, key=lambda r: r["ordinal"]):
        if r["stable_id"] is None:
            continue
        labels, props, _ = out.setdefault((r["provenance_id"], r["stable_id"]), (set(), {}, r["source_kind"]))
        labels |= {x for x in (r["labels"] if r["labels"] is not None else []) if x is not None}
        for k, v in (json.loads(r["props_json"]) if r["props_json"] is not None else {}).items():
            if v is None:
                props.pop(k, None)
            else:
                props[k] = canon(v)
    return out


def p4(entities, prov):
    m = merged(entities)
    by = defaultdict(dict)
    for (run, i), v in m.items():
        by[run][i] = v
    out = set()
    for seq in runs(prov).values():
        for a, b in zip(seq, seq[1:]):
            for i in by[a].keys() | by[b].keys():
                if i not in by[a]:
                    out.add((b, i, "added"))
                elif i not in by[b]:
                    out.add((b, i, "removed"))
                elif by[a][i][:2] != by[b][i][:2]:
                    out.add((b, i, "changed"))
    return out


def p1(entities, prov):
    fields, labels = defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for r in entities:
        at = r["provenance_id"], r["source_kind"]
        for k, v in (json.loads(r["props_json"]) if r["props_json"] is not None else {}).items():
            fields[at][k] |= {jtype(v)} - {None}
        labels[at] |= {x for x in (r["labels"] if r["labels"] is not None else []) if x is not None}
    by = defaultdict(dict)
    for (run, i), v in merged(entities).items():
        by[run, v[2]][i] = v
    kinds = {k for _, k in by}
    out = set()
    for seq in runs(prov).values():
        for a, b in zip(seq, seq[1:]):
            for kind in kinds:
                A, B = (a, kind), (b, kind)
                if not (fields[A] or fields[B] or labels[A] or labels[B]):
                    continue
                both = by[A].keys() & by[B].keys()
                for what, old, new, value in (
                    ("field", fields[A].keys(), fields[B].keys(), None),
                    ("label", labels[A], labels[B], None),
                ):
                    gone, came = set(old - new), set(new - old)
                    pairs = []
                    for x in gone:
                        for y in came:
                            if what == "field":
                                have = [i for i in both if x in by[A][i][1]]
                                n = sum(by[B][i][1].get(y) == by[A][i][1][x] for i in have)
                            else:
                                have = [i for i in both if x in by[A][i][0]]
                                n = sum(y in by[B][i][0] for i in have)
                            if have and 3 * n >= 2 * len(have):
                                pairs.append((-n / len(have), x, y))
                    for _, x, y in sorted(pairs):
                        if x in gone and y in came:
                            gone.discard(x), came.discard(y)
                            out.add((b, kind, what + "_renamed", x, y))
                    out |= {(b, kind, what + "_added", "", y) for y in came} | {(b, kind, what + "_removed", x, "") for x in gone}
                out |= {(b, kind, "field_retyped", k, k) for k in fields[A].keys() & fields[B].keys() if fields[A][k] != fields[B][k]}
    return out


def p2(rels):
    total = Counter(r["provenance_id"] for r in rels)
    out = set()
    for field, share in (("from_id", 20), ("rel_type", Fraction(100, 15))):
        n = Counter((r["provenance_id"], r[field]) for r in rels if r[field] is not None)
        out |= {(run, field, k) for (run, k), c in n.items() if c * share >= total[run]}
    return out


def p3(entities, rels, prov):
    at = defaultdict(set)
    place = {r: (w, k) for w, seq in runs(prov).items() for k, r in enumerate(seq)}
    for e in entities:
        if e["stable_id"] is not None and e["provenance_id"] in place:
            w, k = place[e["provenance_id"]]
            at[w, norm(e["stable_id"])].add(k)
    out = []
    for r in rels:
        if r["provenance_id"] not in place:
            continue
        w, k = place[r["provenance_id"]]
        for end in ("from_id", "to_id"):
            if r[end] is not None and k not in (s := at.get((w, norm(r[end])), set())):
                out.append((r["ordinal"], end, "deleted" if any(x < k for x in s) else "late" if s else "missing"))
    return out


UP = {"PARENT_FOLDER", "IN_FOLDER", "DECLARED_IN", "NESTED_IN"}
DOWN = {"AST_CHILD", "HAS_FLOW_BLOCK"}


def links(entities, rels):
    known = {(e["provenance_id"], norm(e["stable_id"])) for e in entities if e["stable_id"] is not None}
    up = defaultdict(set)
    for r in rels:
        a, b = r["from_id"], r["to_id"]
        if a is None or b is None or r["rel_type"] not in UP | DOWN:
            continue
        a, b = (norm(a), norm(b)) if r["rel_type"] in UP else (norm(b), norm(a))
        a, b = (r["provenance_id"], a), (r["provenance_id"], b)
        if a in known and b in known:
            up[a].add(b)
    return known, up


def p5(entities, rels):
    """Nodes that reach themselves, by Tarjan's components."""
    _, up = links(entities, rels)
    index, low, on, stack, out = {}, {}, set(), [], set()
    for root in list(up):
        if root in index:
            continue
        work = [(root, iter(up.get(root, ())))]
        index[root] = low[root] = len(index)
        stack.append(root), on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w), on.add(w)
                    work.append((w, iter(up.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w), part.append(w)
                        if w == v:
                            break
                    if len(part) > 1 or v in up.get(v, ()):
                        out |= set(part)
    return out
