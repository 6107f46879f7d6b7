"""Hand-made and random document trees, and their operators in plain Python."""

from __future__ import annotations

import json
import random

ARRAYS = ("texts", "tables", "pictures", "groups", "key_value_items", "form_items")


def node(ref, label="text", text=None, page=None, t=None, l=0.0, **more):
    out = {"self_ref": ref, "parent": {"$ref": "#/body"}, "children": [], "label": label, **more}
    if text is not None:
        out["text"] = text
    if page is not None:
        out["prov"] = [{"page_no": page, "bbox": {"l": l, "t": t, "r": l + 50, "b": t - 10, "coord_origin": "BOTTOMLEFT"}, "charspan": [0, 1]}]
    return out


def tree(**arrays):
    out = {"schema_name": "doc", "version": "1", "name": "x", "origin": {"mimetype": "a", "binary_hash": 17150447383450905414, "filename": "x.pdf"}, "body": {"self_ref": "#/body", "children": []}, "pages": {"1": {"size": {"width": 595.0, "height": 842.0}, "page_no": 1}}}
    return out | {a: arrays.get(a, []) for a in ARRAYS}


def cell(text, row, col, t, l, **more):
    return {"bbox": {"l": l, "t": t, "r": l + 5, "b": t - 5, "coord_origin": "BOTTOMLEFT"}, "row_span": 1, "col_span": 1, "start_row_offset_idx": row, "end_row_offset_idx": row + 1, "start_col_offset_idx": col, "end_col_offset_idx": col + 1, "text": text, "column_header": False, "row_header": False, "row_section": False, **more}


def random_tree(seed):
    rng = random.Random(seed)
    arrays = {a: [] for a in ARRAYS}
    for i in range(rng.randint(0, 25)):
        kind = rng.choice(("texts",) * 6 + ARRAYS[1:])
        label = "section_header" if rng.random() < 0.25 else rng.choice(("text", "list_item", "page_footer"))
        place = {} if kind == "groups" or rng.random() < 0.1 else {"page": rng.randint(1, 2), "t": float(rng.randint(0, 3)), "l": float(rng.randint(0, 2))}
        text = rng.choice(("words here", "", " ", "Title", None))
        arrays[kind].append(node(f"#/{kind}/{len(arrays[kind])}", label, text, **place))
    return tree(**arrays)


def write(folder, trees):
    for name, t in trees.items():
        (folder / f"{name}.json").write_text(t if isinstance(t, str) else json.dumps(t))


def ordered(t):
    rows = [(a, n) for a in ARRAYS for n in t[a]]

    def key(row):
        prov = row[1].get("prov")
        return (prov[0]["page_no"], -prov[0]["bbox"]["t"], prov[0]["bbox"]["l"]) if prov else (0, 0.0, 0.0)

    return sorted(rows, key=key)


def attached(t):
    """[(ref, section)] in reading order, and {header: children}."""
    out, kids, now = [], {}, None
    for _, n in ordered(t):
        if n["label"] == "section_header":
            now, section = n["self_ref"], None
            kids[now] = []
        else:
            section = now
            if now:
                kids[now].append(n["self_ref"])
        out.append((n["self_ref"], section))
    return out, kids
