"""A small deterministic DOM on the standard library's HTML parser.

Void elements have no children; an end tag closes up to the nearest open element of its name and is ignored without one;
nothing else is implied, so an unclosed <p> holds what follows until its parent ends.
"""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict, parent: Node | None):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Node | str] = []

    def walk(self):
        """All elements below, in document order."""
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                yield x
                todo.extend(reversed(x.children))

    def find_all(self, *names: str) -> list[Node]:
        return [x for x in self.walk() if x.name in names]

    def find(self, *names: str) -> Node | None:
        return next((x for x in self.walk() if x.name in names), None)

    def strings(self, skip=frozenset(), drop=None):
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            elif x.name not in skip and not (drop and drop(x)):
                todo.extend(reversed(x.children))

    def text(self, skip=frozenset(), drop=None, sep: str = " ") -> str:
        """Stripped strings with a separator between."""
        return sep.join(s for s in (x.strip() for x in self.strings(skip, drop)) if s)

    def get(self, key: str, default: str | None = None) -> str | None:
        v = self.attrs.get(key, default)
        return default if v is None else v

    def has(self, key: str) -> bool:
        return key in self.attrs

    def ancestors(self):
        p = self.parent
        while p is not None:
            yield p
            p = p.parent

    def within(self, *names: str) -> bool:
        return any(a.name in names for a in self.ancestors())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {}, self.stack[-1])
        for k, v in attrs:
            node.attrs.setdefault(k, v if v is not None else "")
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse(page: str) -> Node:
    b = _Builder()
    b.feed(page)
    b.close()
    return b.root
