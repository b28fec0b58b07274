"""A forgiving HTML reader: elements in document order with their text, ready for numpy.

It follows the parts of the HTML standard that decide where text belongs: void
elements, raw text, implied end tags, unmatched end tags, character references.
No recursion, so depth is no limit.
"""

from __future__ import annotations

import re
from html import unescape

#: Comments, declarations and tags. A quote opens a value only after ``=``; what isn't closed goes to the end of the
#: page. Nothing is tried twice, so broken pages take no longer.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?)*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label|data-keep)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style template noscript head title iframe svg annotation annotation-xml".split())
#: What may stand in a head; the start tag of anything else, or text, ends it.
IN_HEAD = frozenset("title meta link base basefont bgsound script style noscript noframes template head html".split())
MATH = frozenset("math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img br picture".split()) | MATH
#: A start tag of the key's set ends an open element of the name, up to the nearest barrier.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"}}
BARRIER = frozenset("ul ol dl table body html article section aside nav div main form fieldset".split())


class Page:
    """Parallel lists over elements (0 is the root) and over pieces of text."""

    __slots__ = ("tags", "parents", "ends", "attrs", "text_owner", "text_block", "texts")

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.ends, self.attrs = ["#root"], [-1], [0], [""]
        self.text_owner: list[int] = []
        self.text_block: list[int] = []
        self.texts: list[str] = []
        self._read(html)

    def _read(self, html: str) -> None:
        tags, parents, ends, attrs = self.tags, self.parents, self.ends, self.attrs
        stack, block, at, n = [0], 0, 0, len(html)
        silent = 0  # how many open elements are silent

        def close(depth: int) -> None:
            nonlocal silent
            while len(stack) > depth:
                i = stack.pop()
                ends[i] = len(tags)
                silent -= tags[i] in SILENT

        def text(piece: str, raw: bool = False) -> None:
            if tags[stack[-1]] == "head" and piece.strip():
                close(len(stack) - 1)
            if piece and not silent:
                self.text_owner.append(stack[-1])
                self.text_block.append(block)
                self.texts.append(unescape(piece) if "&" in piece and not raw else piece)

        while at < n:
            m = TOKEN.search(html, at)
            if not m:
                text(html[at:])
                break
            if m.start() > at:
                text(html[at : m.start()])
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            inline = name in INLINE
            if m[1]:
                for d in range(len(stack) - 1, 0, -1):
                    open_tag = tags[stack[d]]
                    if open_tag == name:
                        close(d)
                        break
                    if inline and open_tag not in INLINE:
                        break  # an inline end tag doesn't end a block
                block += not inline
                continue
            if tags[stack[-1]] == "head" and name not in IN_HEAD:
                close(len(stack) - 1)
            if not inline:
                block += 1
                if name in CLOSES_P or name in IMPLIED:
                    over = IMPLIED.get(name, ())
                    for d in range(len(stack) - 1, 0, -1):
                        open_tag = tags[stack[d]]
                        if open_tag in over or (open_tag == "p" and name in CLOSES_P):
                            close(d)
                        elif open_tag in BARRIER:
                            break
            elif name == "br":
                text(" ")
            if name in VOID:
                continue
            i = len(tags)
            tags.append(name)
            parents.append(stack[-1])
            ends.append(i + 1)
            a = m[3]
            attrs.append(a if a else "")
            if a.endswith("/") and (name == "svg" or name in MATH):
                continue
            stack.append(i)
            silent += name in SILENT
            if name in RAW:
                stop = re.compile(rf"</{name}\s*/?>", re.I).search(html, at)
                if name in ("textarea", "xmp"):
                    text(html[at : stop.start() if stop else n], name == "xmp")
                at = stop.end() if stop else n
                close(len(stack) - 1)
        close(0)
        ends[0] = len(tags)


def names(attrs: str) -> tuple[list[str], str]:
    """Words of the naming attributes, and the value of data-keep (training pages only)."""
    found, keep = [], ""
    for m in ATTRIBUTE.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "data-keep":
            keep = value
        else:
            found += WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
    return found, keep
