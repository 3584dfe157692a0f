"""Exact-byte cases of the reader, the renderings and the price."""

import pytest

from loomwright.kernel import encode, parse, price

#: A document that may be cut anywhere but at its end: what is left breaks off where it ends, or where an unfinished word begins.
WHOLE = '{"city": [true, -2.5e+7, "b\\u00e9", {}], "ok": null, "é": "ü"}'
MISPLACED = [
    ('{"k" "v"}', 5),
    ('{"k":}', 5),
    ("{k:1}", 1),
    ("[5;6]", 2),
    ("[5,,6]", 3),
    ("[ ,5]", 2),
    ('"a"b', 3),
    ("[5]]", 3),
    ('{"k":1}{"k":2}', 7),
    ("007", 0),
    ("-.5", 1),
    ("+1", 0),
    ("[1.e3]", 3),
    ("[2e]", 3),
    ("Infinity", 0),
    ("[nil]", 1),
    ('"\\x41"', 2),
    ('"\\u12G4"', 5),
    ('"line\nbreak"', 5),
    ('["ü",?]', 6),
    ("\ufeff[]", 0),
    ("[6,]", 3),
    ("false true", 6),
]


def rejected_at(text: str) -> int:
    with pytest.raises(parse.Rejected) as e:
        parse.parse(text)
    assert e.value.code == "invalid_json"
    return e.value.byte_offset


def test_rejected_prefixes():
    parse.parse(WHOLE)
    for end in range(len(WHOLE)):
        # an unfinished word is refused where it begins
        begins = next((at for word in ("true", "null") if (at := WHOLE.index(word)) < end < at + len(word)), end)
        assert rejected_at(WHOLE[:end]) == len(WHOLE[:begins].encode()), WHOLE[:end]


@pytest.mark.parametrize(("text", "offset"), MISPLACED)
def test_rejected(text, offset):
    assert rejected_at(text) == offset


@pytest.mark.parametrize("text", ["0.250E-07", "[3.00, 7e2 ,-0.0,1E+3]", '{"k": {"k": [ ]}, "k": null}', '\t"\\uDC01"\n', "1" + "0" * 80])
def test_lexemes_survive(text):
    doc = parse.parse(text)
    assert "".join(doc.tokens) == "".join(text.split())


def test_depth_and_guards():
    with pytest.raises(parse.Rejected) as e:
        parse.parse("[[[1]]]", 2)
    assert (e.value.code, e.value.depth, e.value.limit) == ("depth_exceeded", 3, 2)
    parse.parse("[" * 5000 + "]" * 5000, 5000)
    with pytest.raises(parse.Rejected) as e:
        parse.decode(b"ab\xff")
    assert (e.value.code, e.value.byte_offset) == ("not_utf8", 2)
    with pytest.raises(parse.Rejected) as e:
        parse.decode(b"abc", 2)
    assert (e.value.code, e.value.size, e.value.limit) == ("input_too_large", 3, 2)


GRIDS = [
    ('[{"port":"Oslo","berths":14},{"port":"Kiel","berths":9},{"port":"Riga","berths":14}]', '⏎#3[port,berths]⏎+"Oslo",14⏎+"Kiel",9⏎+"Riga",14⏎'),
    ('[{"kg":5,"lot":"r"},{"kg":6},{"kg":7,"lot":null},{"lot":"s"}]', '⏎#4[kg,lot]⏎+5,"r"⏎+6,~⏎+7,null⏎+~,"s"⏎'),
    ('[{"w":1,"h":2},{"w":3,"d":4,"h":5},{"h":6,"t":7},{"w":8,"d":9}]', "⏎#4[w,d,h,t]⏎+1,~,2,~⏎+3,4,5,~⏎+~,~,6,7⏎+8,9,~,~⏎"),
    ('[{"x":0.5,"y":-1},{"x":1.5,"y":-2},{"y":-3,"x":2.5},{"x":3.5,"y":-4}]', '⏎#4[x,y]⏎+0.5,-1⏎+1.5,-2⏎*{"y":-3,"x":2.5}⏎+3.5,-4⏎'),
    ('[{"ship":{"name":"Ida","crew":{"min":3}}},{"ship":{"name":"Una","crew":{"min":4}}},{"ship":{"name":"Ute"}}]', '⏎#3[ship.name,ship.crew.min]⏎+"Ida",3⏎+"Una",4⏎+"Ute",~⏎'),
    ('[{"tag":{"k":"v"}},{"tag":{"k":"w"}},{"tag":{}}]', '⏎#3[tag]⏎+{"k":"v"}⏎+{"k":"w"}⏎+{}⏎'),
    ('[{"pos":{"lat":1}},{"pos":"unknown"},{"pos":{"lat":2}}]', '⏎#3[pos]⏎+{"lat":1}⏎+"unknown"⏎+{"lat":2}⏎'),
    ('[{"p":{"q":{"r":{"s":{"t":true}}}},"n":1},{"p":{"q":{"r":{"s":{"t":false}}}},"n":2}]', '⏎#2[p.q.r.s,n]⏎+{"t":true},1⏎+{"t":false},2⏎'),
    ('[{"unit":"km","v":10},{"v":11,"unit":"km"},{"unit":"km","v":12},{"unit":"km","v":13}]', '⏎#4[unit="km",v]⏎+10⏎*{"v":11,"unit":"km"}⏎+12⏎+13⏎'),
    ('[{"a":7},{"a":8},{"a":9,"a":10}]', '⏎#3[a]⏎+7⏎+8⏎*{"a":9,"a":10}⏎'),
    ('[{"m":{"x.y":1,"[z]":2}},{"m":{"x.y":3,"[z]":4}}]', '⏎#2[m."x.y",m."[z]"]⏎+1,2⏎+3,4⏎'),
    ('[ {"steps" : [ "go, now" , {"to":"]"} ], "cost":2.50E-3 } , {"steps":[ ], "cost":-0.0} ]', '⏎#2[steps,cost]⏎+["go, now",{"to":"]"}],2.50E-3⏎+[],-0.0⏎'),
    ('{"from":[{"d":1},{"d":2}],"note":"~","to":[{"d":3},{"e":4},{"d":5}]}', '{"from":⏎#2[d]⏎+1⏎+2⏎,"note":"~","to":⏎#3[e,d]⏎+~,3⏎+4,~⏎+~,5⏎}'),
    ('[[{"r":"a"},{"r":"b"}],7,[{"r":"c"},{"r":"d"}]]', '[⏎#2[r]⏎+"a"⏎+"b"⏎,7,⏎#2[r]⏎+"c"⏎+"d"⏎]'),
]


@pytest.mark.parametrize(("text", "body"), GRIDS)
def test_grid(text, body):
    assert encode.grid(parse.parse(text)) == body.replace("⏎", "\n")


@pytest.mark.parametrize("text", ["[4,5]", '[{"z":0}]', '["s",{"z":0}]', "[{},{},{}]", '{"z":[0]}', "true", '[{"z":1,"y":2},{"y":3,"z":4}]', "[" + ",".join(f'{{"k{i}":{i}}}' for i in range(30)) + "]"])
def test_grid_declines(text):
    assert encode.grid(parse.parse(text)) is None


TABLES = [
    ('[{"oak":3},{"oak":4},{"elm":5},{"oak":6},{"ash":7}]', '⏎#5["oak"]⏎+[3]⏎+[4]⏎*{"elm":5}⏎+[6]⏎*{"ash":7}⏎'),
    ('[{"elm":1},{"oak":2},{"oak":3},{"oak":4,"elm":5}]', '⏎#4["oak"]⏎*{"elm":1}⏎+[2]⏎+[3]⏎*{"oak":4,"elm":5}⏎'),
    ('{"t":[{"oak":1,"elm":2},{"oak":3,"elm":4}]}', '{"t":⏎#2["oak","elm"]⏎+[1,2]⏎+[3,4]⏎}'),
    ('["oak","elm"]', None),
    ('[{"oak":1},{"elm":2},{"ash":3}]', None),
]


@pytest.mark.parametrize(("text", "body"), TABLES)
def test_tabular(text, body):
    assert encode.tabular(parse.parse(text)) == (body and body.replace("⏎", "\n"))


MINIFIED = [
    ('"http:\\/\\/h\\/p"', '"http://h/p"'),
    ('"\\u007a\\u005A"', '"zZ"'),
    ('"\\u00df\\u20ac"', '"ß€"'),
    ('"\\u0022q\\u0022"', '"\\"q\\""'),
    ('"c:\\u005cd"', '"c:\\\\d"'),
    ('"\\uD83C\\uDF0D"', '"🌍"'),
    # a lone half of a pair leaves its string as it is
    ('"\\uDC00 x"', '"\\uDC00 x"'),
    ('"\\u0062\\uD800"', '"\\u0062\\uD800"'),
    ('"\\uD83C\\u0041"', '"\\uD83C\\u0041"'),
    ('"a\\u0001b\\u001E"', '"a\\u0001b\\u001e"'),
    ('"\\u000a\\u0009\\u000C"', '"\\n\\t\\f"'),
    ('"\\\\u005a"', '"\\\\u005a"'),
    ('"x\\u0020y"', '"x y"'),
    ('[ true ,\n\t{ "k" : [ ] , "l" : -1.0E+2 } ]', '[true,{"k":[],"l":-1.0E+2}]'),
    # a protected literal leaves its string as it is
    ('{"m":"warning: a\\/b"}', '{"m":"warning: a\\/b"}'),
    ('{"m":"remark: a\\/b"}', '{"m":"remark: a/b"}'),
]


@pytest.mark.parametrize(("text", "body"), MINIFIED)
def test_minify(text, body):
    assert encode.minify(parse.parse(text)) == body


PRICES = [("", 0), ("Zürich", 4), ("one two three", 4), ("tab\t\tstop", 4), ("x=1;y=2", 7), ("   ", 1), ("\x01\x02z", 3), ("日本", 3), ("a\nb", 2), ("12345678901234567890", 6), ("é\xa0é", 3), ("(…)", 4), ("\r\n\r\n", 1), ("ab  cd   ef", 5)]


@pytest.mark.parametrize(("text", "tokens"), PRICES)
def test_heuristic(text, tokens):
    assert price.heuristic(text) == tokens


def test_protected():
    # case counts only for the literals that say so; the first rule that fits names the class
    assert price.protected("Berth request DENIED") == ("denial", "denied")
    assert price.protected("eacces: no quay") is None and price.protected("EACCES: no quay")[0] == "errno"
    assert price.protected("quay ok") is None and price.protected("den\u0131ed") is None


def unfold(body: str) -> str:
    """A reader of the dictionary's legend, from the grammar alone."""
    import re

    explanation, legend, rest = body.split("\n", 2)
    assert explanation == '#refs "$N" = entry N (from 0) of:'
    entries = [t for t in parse.parse(legend[2:]).tokens if t[0] == '"']

    def back(m):
        s = m[0]
        if r := re.fullmatch(r'"\$([0-9]+)"', s):
            return entries[int(r[1])]
        return '"' + s[2:] if re.fullmatch(r'"\$\$+[0-9]+"', s) else s

    return re.sub(r'"(?:[^"\\]|\\.)*"', back, rest)


def test_refs():
    one, two = "berth-" + "q" * 30, "quay-" + "w" * 31
    rows = ",".join(f'{{"ship":"s{i}","at":"{two if i % 4 else one}","seen":"2031-07-0{1 + i // 5}","mark":"$${i}"}}' for i in range(16))
    doc = parse.parse(f'{{"n":16,"calls":[{rows}]}}')
    body = encode.refs(doc, price.heuristic)
    assert {f'"{one}"', f'"{two}"'} <= set(parse.parse(body.split("\n")[1][2:]).tokens)
    assert unfold(body) == encode.grid(doc)
    denied = '{"m":"access denied to every quay"}'
    assert encode.refs(parse.parse(f"[{denied},{denied},{denied}]"), price.heuristic) is None


RECORDS = [
    ('{"k":"v"}\n[0,1]\n', ['{"k":"v"}', "[0,1]"]),
    ('\r\n"a"\r\n\t\n"b"\r\n', ['"a"\r', '"b"\r']),
    ("false\n-2.5\n{}", ["false", "-2.5", "{}"]),
    ('{"k":"v"}\n', None),
    ("0 1\n2", None),
    ('"a"\n\x0c\n"b"', None),
    ("\n\n", None),
]


@pytest.mark.parametrize(("text", "lines"), RECORDS)
def test_records(text, lines):
    assert parse.records(text) == lines


def test_nodes():
    rows = parse.nodes(parse.parse('\t[{"ß":[ ], "n" : -3e2}, null, "zw€"] '))
    assert [(r[1], r[2], r[3], r[4], r[5]) for r in rows] == [
        ("ArrayStart", 1, 2, 0, 3),
        ("ObjectStart", 2, 3, 1, 2),
        ("Key", 3, 7, 2, None),
        ("ArrayStart", 8, 9, 2, 0),
        ("ArrayEnd", 10, 11, 2, None),
        ("Key", 13, 16, 2, None),
        ("Number", 19, 23, 2, None),
        ("ObjectEnd", 23, 24, 1, None),
        ("Null", 26, 30, 1, None),
        ("String", 32, 39, 1, None),
        ("ArrayEnd", 39, 40, 0, None),
    ]


def test_one_encoder_without_a_tree():
    doc = parse.parse('[ {"a" : "\\u0041", "b":[ 1 , 2 ]} ,\n{"a" : "x y", "b":[ ]} ]')
    all_ = dict(encode.candidates(doc, False, "aggressive", price.heuristic))
    doc = parse.parse(doc.text)
    assert encode.candidates(doc, False, "aggressive", None, encode.IDS["min"]) == [(1, '#tkfd1 min\n[{"a":"A","b":[1,2]},{"a":"x y","b":[]}]')]
    assert "root" not in vars(doc) and "tokens" not in vars(doc)
    assert {i: dict(encode.candidates(doc, False, "aggressive", price.heuristic, i)).get(i) for i in all_} == all_
    assert encode.candidates(doc, False, "conservative", None, encode.IDS["grid"]) == []


@pytest.mark.parametrize("text", ["NaN", "[-Infinity]", "[1,]", '{"a":1,}', " []", "[1]\x0b", "[٣]", '"\x1f"', '"\\u+123"', "[1] 2", "", " "])
def test_what_the_library_might_take(text):
    rejected_at(text)


def test_what_the_library_does_not_take():
    text = "[" + "9" * 5000 + ",1e999]"
    assert parse.parse(text).tokens[1] == "9" * 5000
    assert encode.minify(parse.parse(f' [ "\\"{{ [" , "  ", {text} ]')) == f'["\\"{{ [","  ",{text}]'


def test_depth_is_seen_before_the_walk(monkeypatch):
    monkeypatch.setattr(parse, "_walk", None)
    for text in ("[" * 600 + "]" * 600, "[ \n" * 600, '{"a[" : ' * 600, '[{"é\\"":' * 300):
        with pytest.raises(parse.Rejected) as e:
            parse.parse(text)
        assert (e.value.code, e.value.depth, e.value.limit, e.value.byte_offset) == ("depth_exceeded", 513, 512, None)
    parse.parse("[" * 512 + "]" * 512)
    parse.parse("[" + "[]," * 600 + "[]]")


def test_fault_before_the_depth():
    for text, at in (("[}" + "[" * 600, 1), ('{"a" ' * 600, 5), ("[[1 2]," + "[" * 600, 4), ("[[" + "]]" + "[" * 600, 4)):
        assert rejected_at(text) == at
    with pytest.raises(parse.Rejected) as e:
        parse.parse("[0," + "[" * 512 + "?")
    assert e.value.code == "depth_exceeded"
