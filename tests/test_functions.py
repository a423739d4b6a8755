import hashlib

import pytest
from pyspark.sql import functions as F

from agentcorpus.functions import actions, geometry, hashing, points, prompts, text, web
from agentcorpus.operators import score


def python_hash(*parts):
    payload = "\x1f".join(str(p) for p in parts).encode()
    return int.from_bytes(hashlib.sha256(payload).digest()[:8], "big")


def test_stable_hashes_equal_python(value):
    for parts in ((53, "record", "a1"), ("goal", "é"), (1, "")):
        columns = [F.lit(p) for p in parts]
        assert int(value(hashing.stable_int(*columns))) == python_hash(*parts)
        assert value(hashing.stable_mod(97, *columns)) == python_hash(*parts) % 97
    whole = int(hashlib.sha256(b"task").hexdigest(), 16)
    for modulus in (2, 7, 1000):
        assert value(hashing.digest_mod(modulus, F.lit("task"))) == whole % modulus


def test_answers(value):
    assert value(text.normalize_answer(F.lit("The Search-Button!"))) == "search button"
    assert value(text.normalize_answer(F.lit("ﬁle Ⅰ"))) == "file i"
    assert value(text.token_f1(F.lit("red button"), F.lit("the red search button"))) == 0.8
    assert value(text.token_f1(F.lit("a"), F.lit("the"))) == 1.0
    assert value(text.token_f1(F.lit("x"), F.lit(""))) == 0.0
    assert value(text.token_f1(F.lit("x x y"), F.lit("x y y"))) == pytest.approx(2 / 3)
    assert value(text.first_answer(F.lit(" ok \nUSER\nmore"))) == "ok"
    assert value(text.first_answer(F.lit("ok<|im_end|>x"))) == "ok"


def test_long_texts_stay_linear(value):
    left = " ".join(f"w{i % 500}" for i in range(20000))
    right = " ".join(f"w{i % 400}" for i in range(20000))
    assert 0.7 < value(text.token_f1(F.lit(left), F.lit(right))) < 0.9


@pytest.mark.parametrize(
    "url,website,surface",
    [
        ("https://docs.google.com/spreadsheets/d/1", "", "sheets.google.com"),
        ("https://docs.google.com/", "", "docs.google.com"),
        ("https://docs.google.com/forms/x", "", "forms.google.com"),
        ("https://www.Example.com:80/a b", "", "example.com"),
        ("https://me@host.org/x", "", "host.org"),
        ("no url", " Site ", "site"),
        ("", "", "unknown"),
    ],
)
def test_surfaces(value, url, website, surface):
    assert value(web.website_surface(F.lit(url), F.lit(website))) == surface


def test_classification(value):
    def judge(domain, surface, url, rules=()):
        return tuple(value(web.classify_website(F.lit(domain), F.lit(surface), F.lit(url), rules)))

    # Tokens are split only after joining with spaces: "com mail" is one token.
    assert judge("google.com", "mail.google.com", "")[0] == "general_web"
    assert judge("x.com", "x.com", "https://x.com/news/shop")[0] == "transactional_application"
    rules = [("", "skipped"), ("*.bank.example", "service_application")]
    assert judge("a.bank.example", "s", "", rules) == (
        "service_application", "manual", "override:1:*.bank.example",
    )


def test_registrable_domain(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("x.com",), ("localhost",)], "hostname string")
    suffixes = spark.createDataFrame([("uk",), ("co.uk",), ("com",)], "suffix string")
    got = {r["hostname"]: r["registrable"] for r in web.registrable_domain(hosts, suffixes).collect()}
    assert got == {
        "a.b.co.uk": "b.co.uk", "b.co.uk": "b.co.uk", "x.com": "x.com", "localhost": "localhost",
    }


RULES = """// ===BEGIN ICANN DOMAINS===
// a comment
com
uk   the rest of a line is a remark
co.uk

*.ck
!www.ck
jp
*.kobe.jp
!city.kobe.jp
cn
\u516c\u53f8.cn
// ===END ICANN DOMAINS===
// ===BEGIN PRIVATE DOMAINS===
blogspot.com
*.compute.example
// ===END PRIVATE DOMAINS===
"""
SITES = {
    "a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "uk": "uk", "b.uk": "b.uk", "localhost": "localhost",
    "ck": "ck", "b.ck": "b.ck", "a.b.ck": "a.b.ck", "x.a.b.ck": "a.b.ck", "www.ck": "www.ck",
    "x.y.www.ck": "www.ck", "kobe.jp": "kobe.jp", "c.kobe.jp": "c.kobe.jp", "a.c.kobe.jp": "a.c.kobe.jp",
    "x.a.c.kobe.jp": "a.c.kobe.jp", "city.kobe.jp": "city.kobe.jp", "x.city.kobe.jp": "city.kobe.jp",
    "10.0.0.7": "10.0.0.7", "2001:db8::1": "2001:db8::1", "a.b.com.": "b.com", "..": "..", ".com": ".com",
    "x..com": "x..com", "a.b\u3002co.uk": "b.co.uk", "a.b.unknown": "a.b.unknown", "": "", None: None,
    "x.shop.xn--55qx5d.cn": "shop.xn--55qx5d.cn", "x.shop.\u516c\u53f8.cn": "shop.\u516c\u53f8.cn",
    "\u516c\u53f8.cn": "\u516c\u53f8.cn", "x.y.blogspot.com": "blogspot.com",
    ".".join(["a"] * 500) + ".com": "a.com",
}


def test_public_suffix_rules(spark, tmp_path):
    (tmp_path / "rules.dat").write_text(RULES, encoding="utf-8")
    rules = web.read_suffix_list(spark, str(tmp_path / "rules.dat"))
    assert rules.where("private").count() == 2 and rules.where("not private").count() == 10
    hosts = spark.createDataFrame([(h, i) for i, h in enumerate(SITES)], "hostname string, n int")
    got = {r["hostname"]: r["registrable"] for r in web.registrable_domain(hosts, rules).collect()}
    assert got == SITES
    private = web.registrable_domain(hosts, rules, private=True)
    got = {r["hostname"]: r["registrable"] for r in private.collect()}
    assert got == {**SITES, "x.y.blogspot.com": "y.blogspot.com"}
    none = web.registrable_domain(hosts, rules.limit(0))
    assert all(r["hostname"] == r["registrable"] for r in none.collect())


@pytest.mark.parametrize(
    "prediction,point",
    [
        ('```json\n[{"point_2d":[1,2.5],"label":"x"}]```', [1.0, 2.5]),
        ('{"a":[{"point":[3,4,5]}]}', [3.0, 4.0]),
        ('{"point_2d":["1",2]} (9, 8)', [9.0, 8.0]),
        ("Point: [5, 6]", [5.0, 6.0]),
        ("click at (-7,8.5) now", [-7.0, 8.5]),
        ('[{"point_2d":[1,2]}', [1.0, 2.0]),
        ("not valid", None),
        (None, None),
    ],
)
def test_points(spark, prediction, point):
    rows = spark.createDataFrame([(prediction,)], "prediction string")
    got = points.with_point(rows, F.col("prediction"), "p").first()["p"]
    assert got == point


@pytest.mark.parametrize(
    "prediction,reason",
    [
        ('{"thought":"x","action":{"name":"click","x":2.5,"y":5}}', None),
        ('{"thought":"x","action":{"name":"go_back","deep":{"x":true}}}', None),
        ('{"thought":"x","action":{"name":"click","x":true}}', "bad_coordinate"),
        ('{"thought":"x","action":{"name":"click","x":"5"}}', "bad_coordinate"),
        ('{"thought":"x","action":{"name":"click","x":null}}', "bad_coordinate"),
        ('{"thought":"x","action":{"name":"click","x":101}}', "bad_coordinate"),
        ('{"thought":"x","action":{"name":" "}}', "missing_name"),
        ('{"thought":1,"action":{"name":"a"}}', "wrong_types"),
        ('{"thought":"x","action":{"name":"a"},"more":1}', "not_thought_and_action"),
        ('{"thought":"x","action":{"name":"a"}} tail', "invalid_json"),
        ('{"thought":"x","action":{"name":"a"}}}', "invalid_json"),
        ('{"thought":"{","action":{"name":"a"}}]', "invalid_json"),
        ("[1]", "not_thought_and_action"),
        ("not json", "invalid_json"),
        (None, "invalid_json"),
    ],
)
def test_predicted_actions(spark, prediction, reason):
    rows = spark.createDataFrame([(prediction,)], "prediction string")
    assert score.parse_action_predictions(rows).first()["parse_error"] == reason


def test_raw_actions(value):
    def normal(name, raw):
        return value(
            actions.normalize_action(F.lit(name), actions.opened(F.lit(raw)), F.lit(1280), F.lit(720))
        )

    click = normal("click", '{"bbox":[100,100,100,50],"button":"left"}')
    assert click["action"] == '{"name":"click","x":11.7,"y":17.4,"button":"left","click_type":""}'
    assert click["box"] == [100.0, 100.0, 200.0, 150.0]
    assert normal("click", '{"bbox":[1,2,0,5],"x":1,"y":1}')["action"] is None
    assert normal("click", '{"bbox":[1,2,3]}')["action"] is None
    assert normal("click", '{"x":9999,"y":-5}')["action"].startswith('{"name":"click","x":100.0,"y":0.0')
    assert normal("scroll", '{"delta_x":0}')["action"] is None
    assert normal("send_msg_to_user", '{"msg":"hi","bbox":null}')["action"] == (
        '{"name":"send_msg_to_user","msg":"hi"}'
    )
    assert normal("", "{}")["action"] is None
    assert normal("go_back", "[]")["action"] is None


def test_raw_action_arguments_are_read_once(spark):
    # each number was read from the opened action again in every place that refers to it
    rows = spark.createDataFrame([('{"bbox":[1,2,3,4]}',)], "raw string").select(
        actions.opened(F.col("raw")).alias("raw")
    )
    done = actions.normalize_action(F.lit("click"), F.col("raw"), F.lit(1280), F.lit(720))
    plan = rows.select(done.alias("d"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_variant_get(") <= 40


@pytest.mark.parametrize(
    "target,flat",
    [
        ('{"name":"click","x":2.5,"y":5}', True),
        ('{"name": "scroll", "delta_x":-3, "delta_y":400.25}', True),
        ('{"name":"press","key":"Enter"}', True),
        ('{"name":"go_back"}', True),
        ('{"name":"click","x":"5"}', False),
        ('{"name":"click","x":true}', False),
        ('{"name":"click","x":1,"x":2}', False),
        ('{"name":"click","name":"drag"}', False),
        ('{"name":"a","n":01}', False),
        ('{"name":"a\\n"}', False),
        ('{"name":"a"} tail', False),
        ('{"name":"a"}\n', False),
        ('{"x":1,"name":"click"}', False),
        ('{"name":1}', False),
        ('{"name":"a","b":{"x":1}}', False),
        ('[{"name":"a"}]', False),
        ("{}", False),
        (None, False),
    ],
)
def test_flat_actions_read_like_others(spark, target, flat):
    rows = spark.createDataFrame([(target, f'{{"thought":"t","action":{target}}}')], "t string, p string")
    text = F.col("t")
    whole = actions.action_fields(actions.action_arguments(actions.opened(text)))
    got = rows.select(
        actions.flat_action(text).alias("short"), whole.alias("whole"),
        actions.flat_prediction(F.col("p")).alias("predicted"),
        actions.opened(text).isNotNull().alias("valid"),
    ).first()
    assert (got["short"] is not None) == (got["predicted"] is not None) == flat
    if flat:
        assert got["valid"] and got["short"] == got["whole"] == got["predicted"]


def _predicted(action):
    return f'{{"thought":"t","action":{action}}}'


READINGS = [
    "", "not json", "true", "truex", "no", "NaN", "Inf", "[1]", '"a"', 'x {"a":1}',
    *map(_predicted, [
        '{"name":"click","x":true,"y":1}', '{"name":" ","x":true}', '{"name":"","x":"5"}',
        '{"name":"click","x":true,"x":1}', '{"name":"click","x":1,"text":"}","x":2}',
        '{"name":"click","x":true,"text":"}","x":2}', '{"name":"click","flag":true,"x":1,"y":2}',
        '{"name":"scroll","delta_x":false,"delta_y":"a"}', '{"name":"click","x":null,"y":1}',
        '{"name":"k","text":"x: true","max":true}', '{"name":"k","x":truex}', '{"name":"k","x":true}}',
        '{"name":"click","x":01,"y":true}', '{"name":"k","t":"}"}',
    ]),
]


def test_short_readings_of_predictions_equal_the_whole_one(spark, monkeypatch):
    """A brace in a text hid the key that repeats behind it; prose and mistyped numbers need no parser."""
    rows = spark.createDataFrame([(t,) for t in READINGS], "t string")

    def read():
        found = actions.read_prediction(F.col("t"))
        return rows.select("t", found["error"].alias("e"), found["fields"].alias("f")).collect()

    short = read()
    for name in ("FLAT_PREDICTION", "MISTYPED_PREDICTION", "PROSE"):
        monkeypatch.setattr(actions, name, "(?!)")
    assert short == read()


@pytest.mark.parametrize(
    "target",
    ['{"name":"a","text":"x"}', '{"name":"a", "text": "y"}', '{"name":"a","key":"x"}', '{"name":"a","n":1}',
     '{"name":"a","n":1.0}', '{"name":"a","x":"1"}', '{"name":"a"}', '{"name":"a","text":"x","key":"x"}'],
)
def test_single_texts_compare_like_whole_actions(spark, monkeypatch, target):
    others = ['{"name":"a", "text":"x"}', '{"name":"a","text":"X"}', '{"name":"a","n": 1}', '{"name":"a","x":"1"}',
              '{"name":"a","n":"1"}', '{"key":"x","name":"a","text":"x"}', '{"name":"a"}']
    rows = spark.createDataFrame([(_predicted(o), target) for o in others], "t string, target string")

    def equal():
        read, wanted = actions.read_prediction(F.col("t")), actions.read_target(F.col("target"))
        found = actions.equal_actions(F.col("t"), read, F.col("target"), wanted)
        return rows.select("t", found.alias("e")).collect()

    short = equal()
    monkeypatch.setattr(actions, "ONE_TEXT", "(?!)")
    assert short == equal()


def test_rollout_and_policy(value):
    def roll(action):
        return value(actions.rollout_action(actions.opened(F.lit(action))))

    assert roll('{"name":"send_msg_to_user","msg":"[ANSWER] yes"}')["result"] == "yes"
    assert roll('{"name":"scroll","delta_y":-250}')["amount"] == 1.0
    assert roll('{"name":"scroll","delta_y":0}')["error"] == "scroll_needs_delta"
    assert roll('{"name":"hover"}')["error"] == "unsupported"

    def policy(output):
        return value(actions.policy_action_error(actions.strictly_opened(F.lit(output))))

    assert policy('{"action":"click","x":0,"y":1}') is None
    assert policy('{"action":"click","x":0,"y":1.5}') == "click_out_of_range"
    assert policy('{"action":"go_back","x":0}') == "invalid_fields"
    assert policy('{"action":"scroll","direction":"up","amount":0}') == "bad_amount"
    assert policy('{"action":"type","text":""}') == "empty_text"


def test_geometry(value):
    box = F.array(*[F.lit(float(v)) for v in (100, 50, 300, 150)])
    grid = geometry.normalize_bbox(box, F.lit(1000), F.lit(500))
    assert value(geometry.bbox_center(grid)) == [200.0, 200.0]
    assert value(geometry.normalize_bbox(F.array(F.lit(1.0)), F.lit(1), F.lit(1))) is None
    size = value(geometry.target_dimensions(F.lit(2560), F.lit(1440), 1280, 1280))
    assert (size["width"], size["height"]) == (1280, 720)
    assert value(geometry.clamp(F.lit(None).cast("double"), 0.0, 1.0)) is None


def test_prompt_text(value):
    step = F.struct(F.lit(0).alias("step"), F.lit(" go ").alias("thought"), F.lit("{}").alias("action"))
    got = value(prompts.action_prompt(F.lit("g"), F.array(step), F.lit(1), F.lit("T"), F.lit("u")))
    assert got == (
        "# GOAL\ng\n\n# PREVIOUS STEPS\n## Step 0\nTHOUGHT: go\nACTION: {}\n"
        "# CURRENTLY ACTIVE PAGE\nPage 1: T | u\n\n# NEXT STEP"
    )
    with pytest.raises(Exception, match="unsupported task"):
        value(prompts.system_prompt(F.lit("other")))


def test_website_words_and_hosts(value):
    """Dots, slashes and hyphens part tokens; the first listed one of a category wins."""

    def verdict(url):
        found = value(web.classify_website(web.host_domain(F.lit(url)), F.lit(""), F.lit(url)))
        return found["website_category"], found["website_category_rule"]

    assert verdict("https://shop.example/mail-docs") == ("work_application", "url-token:docs")
    assert verdict("https://a.example/shopping") == ("general_web", "fallback")
    assert verdict("https://a-shop.example/NEWS") == ("transactional_application", "url-token:shop")
    assert value(web.hostname(F.lit("http://www.www.a.example/"))) == "www.a.example"
    assert value(web.hostname(F.lit("http://[::1]:80/"))) == "::1"
