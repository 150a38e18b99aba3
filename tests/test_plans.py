import pytest
from pyspark.sql import functions as F

from tidemark.operators import rules
from tidemark.plans import schema as s
from tidemark.plans import tuning
from tidemark.plans.recommend import Planner, Tables, train_model

TEXT = """
version: 1
entities:
  user: { key: id, attributes: { country: { type: categorical, optional: true } } }
  song:
    key: id
    lifecycle: { created: released }
    attributes:
      title:    { type: string }
      genres:   { type: set, of: string }
      energy:   { type: float, range: [0, 1] }
      artist:   { type: string }
      released: { type: timestamp }
interactions:
  play: { weight: 1, value: share, transform: identity, half_life: 30d }
  list: { weight: 4, half_life: 90d, fields: { list_id: { type: string } } }
  skip: { weight: -1 }
context:
  genre: { type: categorical, optional: true }
  mood_words: { type: set, of: string, optional: true }
similarity:
  song:
    - { id: genres, on: genres, metric: jaccard, weight: 0.6 }
    - { id: energy, on: energy, metric: closeness, weight: 0.4 }
  user: [ { via: interactions, metric: cosine } ]
signals:
  content:  { type: item_neighbors, default: 0.5 }
  together: { type: co_occurrence, of: [list], group_by: list_id, measure: lift, default: 0.4 }
  people:   { type: user_neighbors, default: 0.3 }
  popular:  { type: global_count, default: 0.1 }
  recent:   { type: age_decay, half_life: 100d, default: 0.1 }
  rare:     { type: low_exposure, default: 0.05 }
  fit:      { type: attribute_target, on: energy, target: seed.mean, default: 0.1 }
  words:    { type: context_match, on: genres, against: $context.mood_words, default: 0.1 }
  taste:    { type: embedding, factors: 2, iterations: 3, of: [play], default: 0.2 }
  odd:      { type: own_history, default: 0.3 }
constraints:
  - { id: new_only, exclude: { in_seed: true } }
  - { id: not_skipped, exclude: { interacted: [skip] } }
  - { id: genre, require: { attribute: genres, contains: $context.genre } }
rules:
  - { id: spread, quota: { attribute: artist, max: 1, per: 2 } }
knobs:
  - { id: balance, label: Balance, range: [0, 1], default: 0.3, maps: { content: "1 - x", popular: "x" } }
  - { id: energy, label: Energy, range: [0, 1], scope: [add], maps: { similarity.song.energy.weight: "0.8 * x" } }
presets:
  default: { balance: 0.4 }
  crowd: { balance: 1 }
recommenders:
  add:
    for: [song]
    seed: items
    seed_aggregate: 0.2
    candidates: [ { source: item_neighbors, cap: 50 }, { source: co_occurrence, signal: together, cap: 50 }, { source: popular, cap: 50 } ]
    signals: [content, together, people, popular, recent, rare, fit, words, odd]
    constraints: [new_only, genre]
    rules: [spread]
    limit: { default: 4, max: 10 }
  home:
    for: [song]
    seed: user
    candidates: [ { source: user_neighbors }, { source: fresh, cap: 5 }, { source: factors, signal: taste } ]
    signals: [people, recent, taste]
    constraints: [new_only, not_skipped]
    fallback: [ { when: "profile.size == 0", use: top } ]
  top: { for: [song], seed: none, signals: [popular] }
recommendable: song
"""


@pytest.fixture(scope="module")
def tables(spark):
    songs = [("s%d" % i, f"Song {i}", ["rock", "metal"] if i < 5 else ["jazz"], i / 10.0, "abc"[i % 3], f"2024-0{1 + i % 5}-01") for i in range(10)]
    items = spark.createDataFrame(songs, "item string, title string, genres array<string>, energy double, artist string, released string").withColumn("released", F.col("released").cast("timestamp"))
    ev, n = [], 0
    for u in range(8):
        for i in range(5):
            n += 1
            at = (u % 2) * 5 + i
            ev.append((f"u{u}", "list", f"s{at}", None, "2024-05-01", {"list_id": f"l{u}"}, n))
            if (u + i) % 2:
                ev.append((f"u{u}", "play", f"s{at}", 0.5, "2024-05-02", {}, n + 1000))
    ev.append(("u0", "skip", "s4", None, "2024-05-03", {}, 5000))
    events = spark.createDataFrame(ev, "user string, type string, target string, value double, ts string, fields map<string,string>, seq long").withColumn("ts", F.col("ts").cast("timestamp"))
    return Tables(items, events)


@pytest.fixture(scope="module")
def compiled():
    return s.compile_schema(s.parse(TEXT))


def clock():
    return F.lit("2024-06-01").cast("timestamp")


def test_playlist(spark, tables, compiled):
    requests = spark.createDataFrame([(1, "u0"), (2, None)], "request_id int, user string")
    seeds = spark.createDataFrame([(1, 0, "s0"), (1, 1, "s1"), (1, 2, "nothing"), (2, 0, "s7")], "request_id int, seed_pos int, item string")
    got = Planner(compiled, "add", tables, requests, seeds, clock(), {"mood_words": ["metal", "calm"]}).answer().orderBy("request_id", "position").collect()
    assert [r.position for r in got] == [1, 2, 3, 4] * 2
    assert not {("s0", 1), ("s1", 1), ("s7", 2)} & {(r.item, r.request_id) for r in got}
    assert got[0].item in {"s2", "s3", "s4"} and got[4].item in {"s5", "s6", "s8", "s9"}
    for r in got:
        assert r.score == pytest.approx(sum(r.parts.values())) and "odd" not in r.parts
    only = Planner(compiled, "add", tables, requests, seeds, clock(), {"genre": "jazz"}).answer(10).collect()
    assert {r.item for r in only} <= {f"s{i}" for i in range(5, 10)}


def test_home_with_learned_taste(spark, tables, compiled):
    tables.models = {"taste": train_model(compiled, "taste", tables, clock())}
    requests = spark.createDataFrame([(1, "u0")], "request_id int, user string")
    got = Planner(compiled, "home", tables, requests, now=clock()).answer().collect()
    assert got and "s4" not in {r.item for r in got}
    top = Planner(compiled, "top", tables, requests, now=clock()).answer(3).collect()
    assert len(top) == 3


def test_rules_by_guard_and_type(spark, tables):
    """A guard decides request by request; a rule for another type is left out."""
    text = TEXT.replace("- { id: spread, quota: { attribute: artist, max: 1, per: 2 } }", "- { id: spread, when: $context.genre == 'odd', quota: { attribute: artist, max: 1, per: 2 } }\n  - { id: other, for: [user], quota: { attribute: artist, max: 1, per: 2 } }").replace("rules: [spread]", "rules: [spread, other]").replace("constraints: [new_only, genre]", "constraints: [new_only]")
    compiled = s.compile_schema(s.parse(text))
    requests, seeds = spark.createDataFrame([(1, "u0")], "request_id int, user string"), spark.createDataFrame([(1, 0, "s0")], "request_id int, seed_pos int, item string")
    artist = {r.item: r.artist for r in tables.items.collect()}
    lists = {}
    for genre in ("odd", "jazz", None):
        context = {"genre": genre} if genre else {}
        rows = Planner(compiled, "add", tables, requests, seeds, clock(), context).answer(9).orderBy("position").collect()
        lists[genre] = [r.item for r in rows]
        assert [r.position for r in rows] == list(range(1, len(rows) + 1))
    assert lists["jazz"] == lists[None] and sorted(lists["odd"]) == sorted(lists["jazz"])
    order = [lists[None][i] for i in rules.quota_order([artist[i] for i in lists[None]], 1, 2)]
    assert lists["odd"] == order


def test_weights_see_the_context(spark, tables, compiled):
    doc = s.patch(compiled.doc, {"recommenders.add.weights": {"rare": "if($context.genre == 'jazz', 0.7, 0.2)"}})
    requests = spark.createDataFrame([(1, "u0")], "request_id int, user string")
    weight = lambda context: Planner(s.compile_schema(doc), "add", tables, requests, now=clock(), context=context).weights["rare"]
    assert weight({"genre": "jazz"}) == 0.7 and weight({"genre": "rock"}) == 0.2 and weight({}) == 0.0


def test_neighbours_query_is_the_seed_and_the_blend(spark, tables, compiled):
    """For user seeds the last positive items count 1 each, and the profile by its blend."""
    requests = spark.createDataFrame([(1, "u0")], "request_id int, user string")
    plain = Planner(compiled, "home", tables, requests, now=clock())
    assert plain.declared_blend() == plain.knob_blend() == 0.0
    profile = {}
    for r in plain.profiles().collect():
        profile.setdefault(r.user, {})[r.item] = r.w
    seed = {r.item for r in plain.seeds.collect()}
    for blend in (0.0, 0.5):
        top = max(profile["u0"].values())
        q = {i: 1.0 * (i in seed) + blend * profile["u0"].get(i, 0.0) / top for i in seed | set(profile["u0"])}
        size = lambda v: sum(x * x for x in v.values()) ** 0.5
        want = {u: sum(w * v.get(i, 0.0) for i, w in q.items()) / (size(q) * size(v)) for u, v in profile.items() if u != "u0"}
        got = {r.user: r.sim for r in plain.neighbours(blend).collect()}
        assert got == pytest.approx({u: x for u, x in want.items() if x > 0})
    doc = s.patch(compiled.doc, {"recommenders.add.blend_user": 0.3, "knobs.balance.maps": {"recommenders.add.blend_user": "x"}})
    both = Planner(s.compile_schema(doc), "add", tables, requests, now=clock())
    assert both.declared_blend() == 0.3 and both.knob_blend() == 0.4


def test_knobs(compiled):
    r = tuning.resolve_knobs(compiled.doc, "add", "crowd", {"balance": 0.5}, {"balance": 7.0})
    assert r.values["balance"] == 1 and r.clamped == ["balance"] and r.weights == {"content": 0.0, "popular": 1.0}
    assert r.meta == {"similarity.song.energy.weight": 0.4}
    assert tuning.resolve_knobs(compiled.doc, "home").values["balance"] == 0.4
    assert "similarity.song.energy.weight" not in tuning.resolve_knobs(compiled.doc, "home").meta
    for bad in ({"nope": 1.0}, {"balance": float("nan")}):
        with pytest.raises(tuning.RequestError):
            tuning.resolve_knobs(compiled.doc, "add", override=bad)
    with pytest.raises(tuning.RequestError):
        tuning.resolve_knobs(compiled.doc, "home", override={"energy": 1.0})
    assert tuning.term_weights(compiled.doc, "song", r) == {"genres": 0.6, "energy": 0.4}
    assert tuning.neutral("interactions.play.weight_scale") == 1 and tuning.neutral("constraint.energy_center") == 0.5


def test_requests(compiled):
    spec = compiled.doc["recommenders"]["add"]
    assert tuning.limit_of(spec) == 4 and tuning.limit_of(spec, 99) == 10
    with pytest.raises(tuning.RequestError):
        tuning.check_seed(spec, {"item": "x"})
    tuning.check_seed(spec, {"items": [], "user": "u"})
    assert tuning.check_context(compiled.doc, {"mood_words": ["b", "a", "b"]}) == {"mood_words": ["a", "b"]}
    with pytest.raises(tuning.RequestError):
        tuning.check_context(compiled.doc, {"genre": 5})
    assert tuning.fallback(compiled.doc, "home", {"profile.size": 0}) == "top"
    assert tuning.fallback(compiled.doc, "home", {"profile.size": 3}) == "home"
    assert tuning.fallback(compiled.doc, "home", {}) == "home"
    assert tuning.weight_expression("0.2 + 0.2 * min(seed.size, 3) / 3", {"seed.size": 6}) == pytest.approx(0.4)
    assert [k["id"] for k in tuning.knob_panel(compiled, "add")] == ["balance", "energy"]


@pytest.mark.parametrize(
    "old, new, path",
    [
        ("version: 1", "version: 0", "version"), ("key: id, attributes: { country", "attributes: { country", "entities.user.key"), ("type: set, of: string }\n      energy", "type: bag }\n      energy", "entities.song.attributes.genres.type"),
        ("range: [0, 1] }\n      artist", "range: [1, 0] }\n      artist", "entities.song.attributes.energy.range"), ("half_life: 30d", "half_life: soon", "interactions.play.half_life"), ("transform: identity", "transform: 'y + 1'", "interactions.play.transform"),
        ("skip: { weight: -1 }", "skip: { kind: negative, weight: 1 }", "interactions.skip.weight"), ("metric: jaccard", "metric: dice", "similarity.song[0].metric"), ("on: energy, metric", "on: speed, metric", "similarity.song[1].on"),
        ("type: low_exposure", "type: high_exposure", "signals.rare.type"), ("type: low_exposure,", "type: low_exposure, window: 3d,", "signals.rare.window"), ("in_seed: true }", "in_seed: true, equals: 1 }", "constraints[0]"),
        ("attribute: genres, contains", "attribute: genre, contains", "constraints[2].attribute"), ("max: 1, per: 2", "max: 3, per: 2", "rules[0].quota"), ("crowd: { balance: 1 }", "crowd: { balance: 3 }", "presets.crowd.balance"),
        ('content: "1 - x"', 'content: "1 - y"', "knobs[0].maps.content"), ("source: item_neighbors", "source: everything", "recommenders.add.candidates[0].source"), ("use: top }", "use: nowhere }", "recommenders.home.fallback"),
    ],
)
def test_one_mistake_at_a_time(old, new, path):
    assert old in TEXT
    issues = s.validate(s.parse(TEXT.replace(old, new)))
    assert path in {i.path for i in issues}


def test_strict_parsing():
    for bad in ("version: 1\nfoo: 2", "- 1", "a: [", TEXT.replace("weight: -1", "wieght: -1")):
        with pytest.raises(s.SchemaError):
            s.parse(bad)


def test_versions_diff_and_patch():
    v = s.Versions()
    assert v.load(TEXT)[0] == "additive" and v.load(TEXT)[0] == "none" and len(v.history) == 1
    more = TEXT.replace("  skip: {", "  save: { weight: 2 }\n  skip: {")
    assert v.load(more, dry_run=True)[0] == "additive" and len(v.history) == 1
    less = TEXT.replace("      artist:   { type: string }\n", "").replace("  - { id: spread, quota: { attribute: artist, max: 1, per: 2 } }", "  []").replace("    rules: [spread]\n", "")
    less = less.replace("rules:\n  []", "rules: []")
    with pytest.raises(s.SchemaError):
        v.load(less)
    assert v.load(less, confirm=True)[0] == "breaking"
    doc = s.parse(TEXT)
    assert s.patch(doc, {"knobs.balance.default": 1, "signals.odd": None})["knobs"][0]["default"] == 1
    swapped = s.patch(doc, {})
    swapped["knobs"] = swapped["knobs"][::-1]
    assert s.canonical_hash(doc) == s.canonical_hash(swapped)
    assert s.tier("entities.song.attributes.x") == 0 and s.tier("signals.content.default") == 3
    assert any("odd" in w for w in s.warnings(doc))


def test_computed_attributes_in_order():
    from tidemark.sources.ingest import Attribute

    attrs = {"a": Attribute("float"), "b": Attribute("float", computed="a * 2"), "c": Attribute("float", computed="b + a")}
    assert s.computed_order(attrs) == ["b", "c"]
    attrs["a"].computed = "c"
    with pytest.raises(ValueError):
        s.computed_order(attrs)
