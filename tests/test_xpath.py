"""The XPath grammar, and the messages of mappings that use more of it than extraction evaluates."""

import json

import pytest

from lotweave.functions.xpath import is_valid
from lotweave.plans import schemas

VALID = """
/
//a
/html/body/div
//span[@data-qa='vin-value']/text()
//span[1]/text()
//div/following-sibling::p
//div[@class="a" and @id='b']
//a[contains(@href, 'x')]/@href
//p[last()]
//p[position() < 3]
//li[not(@class)]
//*
//*[@id]
//@href
.
..
./a
../b/c
.//p
//a/..
//p[.='x']
//p[normalize-space(.) = 'x y']
//a | //b
(//a)[1]
(//a | //b)[2]/text()
count(//a)
string(//a/@b)
concat('a', "b", 'c')
1 + 2 * 3
- 5
-(-5)
//p[-1]
a[b[c[d]]]
//div[count(p) > 2 or @x != 'y']
//comment()
//processing-instruction()
//processing-instruction('x')
//node()[self::p]
child::div/descendant-or-self::node()/child::p
attribute::class
//svg:rect
//svg:*
re:test(//a, 'x')
$v/a
//a[$n]
div div div
* * *
//a[@b*2 = 4 div 2]
id('x')/p
//p[text()]
  //a  [ 1 ]
/ | //a
//a[. = ..]
.5 + 5.
""".strip("\n").split("\n")

INVALID = """

//
//span[
//span]
//span[]
//a[@]
///a
//a//
//a/
//a[1
//a(1)
//foo()
a b
//a ||//b
//a |
| //a
//a | -b
.[1]
..[1]
//p[contains(@a 'x')]
//p[contains(@a,)]
f(,)
f(a
(//a
//a)
()
@
//@
//a::b
unknown::p
child::
//p['x]
//p["x']
1 +
= 2
//text('x')
//comment(1)
//a[@b=]
a:
:a
//a!
a # b
$ 
//a[1]]
f()()
//p/1
/1
//*()
//processing-instruction(x)
""".strip("\n").split("\n")


@pytest.mark.parametrize("text", VALID)
def test_valid(text):
    assert is_valid(text)


@pytest.mark.parametrize("text", INVALID)
def test_invalid(text):
    assert not is_valid(text)


def test_deep_nesting_takes_no_recursion():
    assert is_valid("a[" * 50_000 + "1" + "]" * 50_000) and not is_valid("(" * 50_000 + "1" + ")" * 49_999)


def test_messages_of_a_mapping(spark):
    config = {
        "vin": "//span[1]/text()", "goal": "Buy", "price": "//div/following-sibling::p", "make": "//span[", "_note": "//[",
        "model": ["//a", "//b[", ".c["], "color": ".x >", "trim": {"selector": "//q[", "type": "xpath"}, "year": "//b/text()",
    }
    r = schemas.validate_mapping(spark.createDataFrame([("s", json.dumps(config)), ("none", "{}")], "site_id string, config string")).collect()
    got = {x["site_id"]: x for x in r}
    assert got["s"]["errors"] == ["Invalid selector for make: //span[", "Invalid selector for model: //b["] and not got["s"]["valid"]
    assert got["s"]["warnings"] == [
        "Price selector might not target price element",
        "Selector for price is valid but not evaluated: //div/following-sibling::p",
        "Selector for vin is valid but not evaluated: //span[1]/text()",
    ]
    assert got["none"]["errors"] == ["Missing required field: vin", "Missing required field: goal"] and got["none"]["warnings"] == []
