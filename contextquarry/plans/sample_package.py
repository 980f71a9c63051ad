"""A small package that shows what the code index has to get right, and what it has to find."""

FILES = {
    "shop/__init__.py": "from .items import *\nfrom .cart import Cart as Basket\nfrom .items import price\n",
    "shop/items.py": '''"""Things for sale."""
from __future__ import annotations
import typing

TAX = 2


class Item:
    """

    An item.
    With a price.
    """
    size = 3
    "a bare text"
    class Inner:
        pass
    def price(self) -> int:
        """Its price."""
        return rate(self.size)


def rate(n: "int"):
    return n


def rate(n: Item = None, ü="é"):  # named twice
    return Item()


def _hidden(): pass


if TAX:
    def conditional(): pass
''',
    "shop/cart.py": """from typing import TYPE_CHECKING
from . import items
from .items import Item

if TYPE_CHECKING:
    from .deep.far import Far


def deco(f):
    return f


class Cart(Item, metaclass=deco):
    @deco
    def add(self, x: items.Item.price) -> Item:
        def inner():
            return Item()
        with x:
            self.add(Far())
        return Far()
""",
    "shop/deep/__init__.py": "from .. import cart\nfrom ..... import cart\n",
    "shop/deep/far.py": "from ..cart import Cart\nfrom shop.items import *\n\n\nclass Far(Cart):\n    pass\n",
    # both have the name; the first import binds it
    "shop/pick.py": "from .second import f\nfrom .first import f\n",
    "shop/first.py": "def f(): pass\n",
    "shop/second.py": "def f(): pass\n",
    # the first import can bind only in a later round, as its target gets the name after this file had its turn
    "shop/late.py": "from .relay import g\nfrom .near import g\n",
    "shop/near.py": "def g(): pass\n",
    "shop/relay.py": "from .source import g\n",
    "shop/source.py": "def g(): pass\n",
}

_I, _C = "shop/items.py::", "shop/cart.py::"
RATE = f"{_I}rate#27"
MODULE = "<module>"

#: id, kind, first line, last line, signature, first line of documentation, rest of it, body
SYMBOLS = [
    *((f"{f}::{MODULE}", "module", 1, FILES[f].count("\n") + 1, "", "Things for sale." if f == "shop/items.py" else "", "", "") for f in FILES),
    (f"{_I}Item", "class", 8, 20, "class Item:", "An item.", "With a price.", "size = 3\n\nclass Inner:\n        pass"),
    (f"{_I}Item.price", "method", 18, 20, "def price(self) -> int:", "Its price.", "", "\n        return rate(self.size)"),
    (f"{_I}rate#23", "func", 23, 24, 'def rate(n: "int"):', "", "", "return n"),
    (RATE, "func", 27, 28, 'def rate(n: Item = None, ü="é"):  # named twice', "", "", "return Item()"),
    (f"{_I}_hidden", "func", 31, 31, "def _hidden():", "", "", "pass"),
    (f"{_C}deco", "func", 9, 10, "def deco(f):", "", "", "return f"),
    (f"{_C}Cart", "class", 13, 20, "class Cart(Item, metaclass=deco):\n    @deco", "", "", ""),
    (f"{_C}Cart.add", "method", 15, 20, "def add(self, x: items.Item.price) -> Item:", "", "", "def inner():\n            return Item()\n        with x:\n            self.add(Far())\n        return Far()"),
    ("shop/deep/far.py::Far", "class", 5, 6, "class Far(Cart):", "", "", "pass"),
    *((f"shop/{m}.py::{f}", "func", 1, 1, f"def {f}():", "", "", "pass") for m, f in (("first", "f"), ("second", "f"), ("near", "g"), ("source", "g"))),
]

#: file, name, the file and qualified name that it stands for
EXPORTS = [
    *((f, n, "shop/items.py", n) for f in ("shop/items.py", "shop/__init__.py", "shop/deep/far.py") for n in ("Item", "rate")),
    ("shop/items.py", "_hidden", "shop/items.py", "_hidden"),
    ("shop/__init__.py", "Basket", "shop/cart.py", "Cart"),
    *(("shop/cart.py", n, f, n) for n, f in (("deco", "shop/cart.py"), ("Cart", "shop/cart.py"), ("Item", "shop/items.py"), ("Far", "shop/deep/far.py"))),
    *(("shop/deep/far.py", n, f, n) for n, f in (("Far", "shop/deep/far.py"), ("Cart", "shop/cart.py"))),
    *((f"shop/{f}.py", "f", f"shop/{t}.py", "f") for f, t in (("first", "first"), ("second", "second"), ("pick", "second"))),
    *((f"shop/{f}.py", "g", f"shop/{t}.py", "g") for f, t in (("near", "near"), ("source", "source"), ("relay", "source"), ("late", "near"))),
]

#: from, to, kind, weight
EDGES = [
    (f"{_I}Item.price", RATE, "call", 1),
    (RATE, f"{_I}Item", "annotation", 1),
    (RATE, f"{_I}Item", "call", 1),
    (f"{_C}{MODULE}", f"{_I}{MODULE}", "import", 1),
    (f"{_C}{MODULE}", f"{_I}Item", "import", 1),
    (f"{_C}Cart", f"{_I}Item", "inheritance", 1),
    (f"{_C}Cart.add", f"{_C}deco", "decorator", 1),
    (f"{_C}Cart.add", f"{_I}Item", "annotation", 1),
    (f"{_C}Cart.add", "shop/deep/far.py::Far", "call", 2),
    (f"shop/deep/__init__.py::{MODULE}", f"{_C}{MODULE}", "import", 1),
    ("shop/deep/far.py::Far", f"{_C}Cart", "inheritance", 1),
    *((f"shop/{f}.py::{MODULE}", to, "import", 1) for f in ("__init__", "deep/far") for to in (f"{_C}Cart", f"{_I}Item", RATE, f"{_I}_hidden")),
    *((f"shop/pick.py::{MODULE}", f"shop/{t}.py::f", "import", 1) for t in ("first", "second")),
    *((f"shop/{f}.py::{MODULE}", f"shop/{t}.py::g", "import", 1) for f, t in (("late", "source"), ("late", "near"), ("relay", "source"))),
]
