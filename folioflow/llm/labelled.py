"""Documents labelled by construction: prose, lists, tables and junk in many layouts, built from sample sentences."""

from __future__ import annotations

import random
import re
from collections.abc import Callable

_END = re.compile(r"(?<=[.!?…])\s+")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


class Builder:
    """Builds documents from texts of running prose; the same texts and seed give the same documents."""

    def __init__(self, texts: list[str], seed: int = 0) -> None:
        self.r, self.texts = random.Random(seed), texts
        self.alike: dict[int, list[float]] = {}
        self.by_text = [[s.strip() for s in _END.split(t.replace("\n", " ")) if len(_LETTERS.findall(s)) >= 4] for t in texts]
        self.by_text = [s for s in self.by_text if len(s) >= 3]
        self.words = [{w.lower() for x in s for w in _LETTERS.findall(x)} for s in self.by_text]
        if not self.by_text:
            raise ValueError("no prose to build labelled documents from")

    def start(self) -> None:
        """Begin a document: its sentences come from one text, then from the most similar others, each once before any comes again."""
        k = self.r.randrange(len(self.words))
        if k not in self.alike:
            self.alike[k] = [len(self.words[k] & w) / (1 + len(self.words[k] | w)) for w in self.words]
        near = [(x + self.r.random() / 50, i) for i, x in enumerate(self.alike[k])]
        self.order = [i for _, i in sorted(near, reverse=True)]
        self.at, self.left, self.bare = 0, [], self.r.random() < 0.5

    def sentence(self) -> str:
        if not self.left:
            self.left = list(self.by_text[self.order[self.at % len(self.order)]])
            self.r.shuffle(self.left)
            self.at += 1
        return self.left.pop()

    def phrase(self) -> str:
        """One to three words of a sentence; in half of the documents long ones alone, as entries often have no small words."""
        w = _LETTERS.findall(self.sentence())
        w = [x for x in w if len(x) >= 5] or w if self.bare else w
        k = self.r.choice((1, 1, 2, 2, 3))
        i = self.r.randrange(max(1, len(w) - k))
        name = f" {self.r.choice('«“')}{self.r.choice(w)}{self.r.choice('»”')}" if self.r.random() < 0.1 else ""
        return " ".join(w[i : i + k]) + name

    def number(self) -> str:
        r = self.r
        return r.choice((str(r.randint(1, 999)), str(r.randint(1000, 9999)), f"{r.uniform(1, 999):.{r.choice((1, 2, 3))}f}", "—", ""))

    def prose(self) -> str:
        r = self.r
        paragraphs = [" ".join(self.sentence() for _ in range(r.randint(1, 6))) for _ in range(r.choice((1, 1, 1, 2, 2, 3, 4, 6, 12)))]
        return "\n\n".join(paragraphs)

    def wrap(self, text: str, width: int) -> str:
        out, line = [], ""
        for word in text.split(" "):
            if line and len(line) + 1 + len(word) > width:
                out.append(line)
                line = word
            else:
                line = f"{line} {word}".strip()
        return "\n".join([*out, line])

    def entries(self, low: int = 5, high: int = 40) -> list[str]:
        e = [self.phrase() for _ in range(self.r.randint(low, high))]
        return [x.capitalize() for x in e] if self.r.random() < 0.4 else e

    # prose layouts
    def prose_plain(self) -> str:
        return self.prose()

    def prose_wrapped(self) -> str:
        return "\n".join(self.wrap(p, self.r.choice((26, 32, 40, 52, 64, 72))) for p in self.prose().split("\n\n"))

    def prose_lines(self) -> str:
        return "\n".join(self.sentence() for _ in range(self.r.randint(3, 40)))

    def prose_bare(self) -> str:
        return re.sub(r"[^\w\s'’°-]", "", self.prose().replace("\n\n", self.r.choice(("\n", " ")))).lower()

    def prose_verse(self) -> str:
        r = self.r
        lines = []
        for _ in range(r.randint(2, 8)):
            lines += self.wrap(self.sentence(), r.choice((22, 28, 34))).split("\n") + [""] * (r.random() < 0.3)
        return "\n".join(re.sub(r"[.,;]$", r.choice(("", ",")), x) if r.random() < 0.4 else x for x in lines)

    def prose_dialogue(self) -> str:
        return "\n".join(self.r.choice(("— ", "– ", "- ", '"', "“", "«")) + self.sentence() for _ in range(self.r.randint(3, 20)))

    def prose_marked(self) -> str:
        r = self.r
        mark = r.choice((f" (x² + {r.randint(2, 9)}y = {r.randint(10, 99)}) [{r.randint(1, 60)}]", f" [{r.randint(1, 99)}]", f" <i>{self.phrase()}</i>", f" `{self.phrase()}`"))
        out = []
        for p in self.prose().split("\n\n"):
            out.append(re.sub(r"([.!?])(?=\s|$)", lambda m: mark + m[1] if r.random() < 0.7 else m[1], p))
        head = f"# {self.phrase().capitalize()}\n\n" if r.random() < 0.4 else ""
        return head + "\n\n".join(out)

    def prose_with_part(self) -> str:
        r = self.r
        part = r.choice((self.list_marked, self.table_cells))().split("\n")[: r.randint(2, 5)]
        return "\n\n".join([self.prose(), "\n".join(part), self.prose(), self.prose()])

    def prose_long(self) -> str:
        return "\n\n".join(" ".join(self.sentence() for _ in range(self.r.randint(2, 7))) for _ in range(self.r.randint(10, 50)))

    def prose_one_line(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(8, 150)))

    def prose_as_it_is(self) -> str:
        return self.r.choice(self.texts)

    # lists
    def list_marked(self) -> str:
        r = self.r
        mark = r.choice((lambda i: "- ", lambda i: "* ", lambda i: "• ", lambda i: "— ", lambda i: f"{i}. ", lambda i: f"{i}) ", lambda i: f"({i}) ", lambda i: f"№{i} ", lambda i: "[ ] ", lambda i: f"{chr(96 + (i - 1) % 26 + 1)}) "))
        end = r.choice(("", "", ";", "."))
        return "\n".join(mark(i) + x + (end if r.random() < 0.6 else "") for i, x in enumerate(self.entries(), 1))

    def list_plain(self) -> str:
        return "\n".join(self.entries(6, 45))

    def list_inline(self) -> str:
        return self.r.choice(("; ", " · ", ", ")).join(self.entries(12, 60))

    def list_index(self) -> str:
        r = self.r
        return "\n".join(f"{x}, " + ", ".join(str(n) for n in sorted(r.sample(range(1, 400), r.randint(1, 5)))) for x in sorted(self.entries()))

    def list_contents(self) -> str:
        r, page, out = self.r, 1, []
        dot = r.choice((".", "·", " ", ". ", "\t", "…"))
        for i, x in enumerate(self.entries(), 1):
            page += r.randint(1, 14)
            out.append((f"{r.randint(1, 9)}.{i} " if r.random() < 0.3 else "") + f"{x} {dot * r.randint(4, 30) if dot != chr(9) else dot} {page}")
        return "\n".join(out)

    def list_references(self) -> str:
        r = self.r
        form = r.choice((lambda i: f"[{i}] {self.phrase().title()}, {r.choice('ABCDEFGIKLM')}. {self.phrase().capitalize()}. {self.phrase().capitalize()}, {r.randint(1950, 2024)}, {r.randint(1, 60)}({r.randint(1, 9)}), {r.randint(1, 99)}–{r.randint(100, 300)}.", lambda i: f"{i}. {self.phrase().title()} {r.choice('АБВГДЕ')}. {self.phrase().capitalize()}. — {r.randint(1950, 2024)}. — {r.randint(80, 500)} p."))
        return "\n".join(form(i) for i in range(1, r.randint(6, 40)))

    def list_with_intro(self) -> str:
        return self.sentence() + "\n\n" + self.r.choice((self.list_marked, self.list_plain, self.list_index, self.list_contents))()

    # tables
    def rows(self) -> list[list[str]]:
        r = self.r
        k = r.randint(3, 10)
        numbers, decimals = r.choice((0.4, 0.7, 0.95)), r.choice((0.0, 0.3, 0.6))
        one = lambda: f"{r.uniform(1, 999):.{r.choice((1, 2, 3))}f}" if r.random() < decimals else self.number()
        body = [[one() if r.random() < numbers else self.phrase().split()[0] for _ in range(k)] for _ in range(r.randint(6, 50))]
        return [[self.phrase().split()[0].capitalize() for _ in range(k)], *body]

    def table_cells(self) -> str:
        sep = self.r.choice(("\t", ";", "|", ",", " | "))
        return "\n".join(sep.join(x) for x in self.rows())

    def table_markdown(self) -> str:
        rows = self.rows()
        return "\n".join("| " + " | ".join(x) + " |" for x in [rows[0], ["---"] * len(rows[0]), *rows[1:]])

    def table_columns(self) -> str:
        right = self.r.random() < 0.5
        return "\n".join("".join(f"{c:>14}" if right else f"{c:<16}" for c in x).rstrip() for x in self.rows())

    def table_grid(self) -> str:
        rows = self.rows()
        bar = "+" + "+".join(["-" * 14] * len(rows[0])) + "+"
        return "\n".join([bar, *("|" + "|".join(f"{c:^14}" for c in x) + "|" for x in rows), bar])

    def table_with_intro(self) -> str:
        return self.sentence() + "\n\n" + self.r.choice((self.table_cells, self.table_markdown, self.table_columns, self.table_grid))()

    # junk
    def noise(self, alphabet: str, low: int = 100, high: int = 1500) -> str:
        return "".join(self.r.choice(alphabet) for _ in range(self.r.randint(low, high)))

    def junk_symbols(self) -> str:
        return self.noise("01235789oOIl[]{}<>|/\\^~`#&*%$@!?,.;:'=+_    ")

    def junk_dump(self) -> str:
        r = self.r
        alphabet = r.choice(("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
        return r.choice(("\n", "\n", "")).join("".join(r.choice(alphabet) for _ in range(r.choice((32, 64)))) for _ in range(r.randint(4, 30)))

    def junk_hexdump(self) -> str:
        r = self.r
        return "\n".join(f"{i * 16:08x}  " + " ".join(f"{r.randrange(256):02x}" for _ in range(16)) for i in range(r.randint(5, 30)))

    def junk_numbers(self) -> str:
        return " ".join(str(self.r.randrange(10 ** self.r.randint(1, 8))) for _ in range(self.r.randint(30, 300)))

    def junk_menu(self) -> str:
        r = self.r
        items = ["Home", "Menu", "Login", "RSS", "Top", "Help", "OK", "Next »", "« Back", "Print", "Share", "Cookies", "1 2 3 4", "Меню", "Главная", "Войти"]
        return r.choice((" | ", "  ", "\n", " · ", " ")).join(r.choice(items) for _ in range(r.randint(25, 130)))

    def junk_markup(self) -> str:
        r = self.r
        tag = lambda: r.choice(("div", "span", "td", "li", "a", "p", "img", "br"))
        return "".join(f'<{tag()} class="{self.noise("abcdefgh-", 3, 9)}" id="x{r.randint(1, 999)}">' + (f"</{tag()}>" if r.random() < 0.6 else self.phrase()) + "\n" * (r.random() < 0.3) for _ in range(r.randint(10, 60)))

    def junk_json(self) -> str:
        r = self.r
        return "{" + ",".join(f'"{self.noise("abcdefgh_", 3, 9)}":{r.choice((str(r.randint(0, 9999)), "null", "true", "[]", chr(34) + self.noise("abcdef0123", 4, 12) + chr(34)))}' for _ in range(r.randint(15, 80))) + "}"

    def junk_repeat(self) -> str:
        r = self.r
        what = self.phrase() if r.random() < 0.5 else self.sentence()
        what += r.choice(("", "", "!!! ", " >> ", " ... ", "."))
        return r.choice(("\n", ", ", " ", " | ")).join([what] * r.randint(8, 90))

    def junk_letters(self) -> str:
        r = self.r
        alphabet = r.choice(("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшщыьэюя"))
        out, sizes = [], r.choice(((1, 1, 2, 2, 3, 5, 7), (1, 2, 3, 4, 6, 9), (1, 1, 2)))
        for _ in range(r.randint(30, 400)):
            out.append("".join(r.choice(alphabet) for _ in range(r.choice(sizes))) + r.choice(("", "", "", ".", ",", ";", "~")))
        return " ".join(out)


WEIGHTS = {"prose_plain": 4, "prose_wrapped": 3, "list_marked": 3, "list_plain": 2, "list_inline": 2, "list_with_intro": 3, "prose_bare": 3, "prose_dialogue": 5, "prose_marked": 5, "prose_long": 3, "prose_lines": 2, "prose_as_it_is": 2, "prose_verse": 2, "list_contents": 2, "list_index": 2, "junk_symbols": 2, "junk_menu": 2, "junk_repeat": 2, "table_cells": 3, "junk_letters": 3, "table_columns": 2}


def build(texts: list[str], per_layout: int = 60, seed: int = 0) -> list[tuple[str, str]]:
    """(text, kind) pairs: per_layout documents of each layout, more of the common ones."""
    b = Builder(sorted(texts), seed)
    out = []
    for name in sorted(n for n in dir(Builder) if n.partition("_")[0] in ("prose", "list", "table", "junk") and "_" in n):
        make: Callable[[], str] = getattr(b, name)
        for _ in range(per_layout * WEIGHTS.get(name, 1)):
            b.start()
            out.append((make(), name.partition("_")[0]))
    return out
