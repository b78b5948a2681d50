"""Trees as rules in text and as Graphviz DOT."""

from __future__ import annotations

import math
from collections.abc import Sequence

from .plans.nodes import Node, preorder


# Fixed values of the output format: node and edge styles, the fill of leaves, the text of an empty tree.
NODE_STYLE = 'node [shape=box, style="rounded,filled", fontname=helvetica, fillcolor="#f5f5f5"] ;'
EDGE_STYLE = "edge [fontname=helvetica] ;"
LEAF_FILL = "#e8f4ea"
EMPTY = "(empty tree)"


def _name(node: Node, names: Sequence[str] | None) -> str:
    return str(names[node.feature]) if names is not None and node.feature < len(names) else f"x[{node.feature}]"


def condition_text(node: Node, names: Sequence[str] | None = None) -> str:
    name = _name(node, names)
    if node.is_categorical:
        return f"{name} == {node.category}"
    low, high = math.isfinite(node.lower), math.isfinite(node.upper)
    if low and high:
        return f"{node.lower:.4g} <= {name} < {node.upper:.4g}"
    if high:
        return f"{name} < {node.upper:.4g}"
    return f"{name} >= {node.lower:.4g}" if low else f"{name} (any)"


def leaf_text(node: Node, classes: Sequence | None = None) -> str:
    if not node.proba:
        return f"value={node.value:.4g} n={node.n_samples}"
    c = node.predicted_class
    label = classes[c] if classes is not None and c < len(classes) else c
    return f"class={label} n={node.n_samples} proba=[{', '.join(f'{p:.3f}' for p in node.proba)}]"


def export_text(root: Node | None, feature_names: Sequence[str] | None = None, class_names: Sequence | None = None, indent: str = "  ") -> str:
    if root is None:
        return EMPTY
    lines, stack = [], [(root, "")]
    while stack:
        item, pad = stack.pop()
        if isinstance(item, str):
            lines.append(pad + item)
        elif item.is_leaf:
            lines.append(pad + leaf_text(item, class_names))
        else:
            test = condition_text(item, feature_names)
            lines.append(f"{pad}if {test}:")
            stack += [(item.right, pad + indent), (f"else:  # not ({test})", pad), (item.left, pad + indent)]
    return "\n".join(lines)


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def export_graphviz(root: Node | None, feature_names: Sequence[str] | None = None, class_names: Sequence | None = None, name: str = "Tree") -> str:
    nodes = preorder(root)
    at = {id(n): i for i, n in enumerate(nodes)}
    body = [] if nodes else [f"  empty [label={_quoted(EMPTY)}] ;"]
    for i, n in enumerate(nodes):
        if n.is_leaf:
            body.append(f'  {i} [label={_quoted(leaf_text(n, class_names))}, fillcolor="{LEAF_FILL}"] ;')
        else:
            body.append(f"  {i} [label={_quoted(f'{condition_text(n, feature_names)}\\nn={n.n_samples}')}] ;".replace("\\\\n", "\\n"))
    for i, n in enumerate(nodes):
        if not n.is_leaf:
            body += [f'  {i} -> {at[id(n.left)]} [label="true"] ;', f'  {i} -> {at[id(n.right)]} [label="false"] ;']
    return "\n".join([f"digraph {name} {{", f"  {NODE_STYLE}", f"  {EDGE_STYLE}", *body, "}"])
