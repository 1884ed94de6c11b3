"""The main text of a page by plain walks: each text to all its ancestors, each node to all others.

Only the reading of tags is shared with the library.
"""

import re

from pinax.llm import html_text as h


def up(node):
    while node is not None:
        yield node
        node = node.parent


def tree_of(html):
    tree = h.Tree()
    tree.feed(html)
    tree.close()
    return tree


def without_furniture(tree):
    nodes = tree.nodes
    below = {n.no: {m.no for m in nodes if n in up(m)} for n in nodes}
    own = {n.no: sum(len(t) - min(k, len(t)) for x, t, k in tree.texts if x.no in below[n.no]) for n in nodes}
    given = {n.no: n.dropped for n in nodes}
    for n in nodes[1:]:
        if n.parent.dropped:
            n.dropped = True
            continue
        if not n.soft or n.dropped or n.plain:
            continue
        if any(m.plain and not given[m.no] and own[m.no] for m in nodes if m.no in below[n.no] and m is not n):
            continue
        heading = next((t for x, t, _ in tree.texts if x.tag in h.HEADINGS and x.parent is n), None)
        slug = heading and re.sub(r"[\\W_]+", "-", heading.lower()).strip("-")
        if n.anchor and not n.anchor.startswith(("comment", "repl")) and slug == n.anchor:
            continue
        rivals = [m for m in nodes if (m.plain or m.named) and not any(x.soft or given[x.no] for x in up(m))
                  and m.no not in below[n.no] and n.no not in below[m.no]]
        n.dropped = 2 * own[n.no] <= own[0] or any(10 * own[m.no] >= own[n.no] for m in rivals)
    return [x for x in tree.texts if not x[0].dropped]


def main_text(html):
    tree = tree_of(html)
    texts = without_furniture(tree)
    if not texts:
        return ""
    nodes = tree.nodes
    length = {n.no: sum(len(t) for x, t, _ in texts if n in up(x)) for n in nodes}
    links = {n.no: sum(k for x, _, k in texts if n in up(x)) for n in nodes}
    whole = {n.no for n in nodes if n.tag == "article" or (n.plain and length[n.no])}
    for n in nodes:
        if n.tag == "article" and n.plain and length[n.no]:
            whole -= {m.no for m in up(n.parent) if m.tag != "article"}
    score = {n.no: float(n.named) for n in nodes}
    for x, t, k in texts:
        points = (1 + t.count(",") + min(len(t) / 100, 3)) * (1 - min(1.0, k / len(t)))
        share = 1.0
        for n in up(x if x.tag in h.CONTAINER else x.parent):
            if n.tag in h.CONTAINER:
                score[n.no] += points if n.no in whole else points * share
                share /= 2
    holders = [n for n in nodes if n.tag in h.CONTAINER and length[n.no]] or nodes[:1]
    worth = {n.no: round(score[n.no] * (1 - min(1.0, links[n.no] / max(1, length[n.no]))), 9) for n in holders}
    best = max(holders, key=lambda n: worth[n.no])
    kept = {best.no} | {n.no for n in holders if n.parent is best.parent and worth[n.no] >= max(10.0, worth[best.no] / 5)}
    opened = set()
    if not (best.plain or best.tag in ("article", "main", "body")):
        in_main = any(n.plain for n in up(best.parent))
        at = best
        while at.parent is not None:
            top = at.parent
            kept |= {n.no for n in nodes[1:] if n.parent is top and n is not at and 4 * links[n.no] < length[n.no]}
            opened.add(top.no)
            stop = (at.named if at is best else 0) or top.named
            if top.plain or top.tag in ("body", "html", "#page") or 4 * links[top.no] >= length[top.no] or (stop and not in_main):
                break
            at = top
    return "\n".join(t for x, t, k in texts
                     if any(n.no in kept for n in up(x)) or (x.no in opened and 4 * k < len(t)))
