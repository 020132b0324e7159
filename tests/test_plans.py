"""Plans: reading, checking, writing, explaining, and the wizard. No Spark needed."""

import copy
import json

import pytest
import yaml

from tabloom.plans import explain, spec, wizard
from tabloom.plans.check import event_order
from tabloom.plans.spec import MetadataError, dump, load, parse
from tabloom.plans.wizard import Wizard

#: A lending library: members of three branches, and the loans that each of them takes.
LIBRARY = yaml.safe_load("""
version: 1
seed: 7
tables:
  members:
    role: root
    rows: 400
    primary_key: member_id
    columns:
      member_id: {type: int64, generator: key}
      branch: {type: string, distribution: {kind: categorical, categories: [harbour, hill, market], probs: [0.2, 0.5, 0.3]}}
      years: {type: int64, distribution: {kind: normal, mean: 35, std: 11}, clamp: [7, 90], round: true}
      budget: {type: float64, distribution: {kind: lognormal, mu: 5.2, sigma: 0.5}}
      joined_at: {type: timestamp, distribution: {kind: datetime_uniform, start: '2018-05-01T00:00:00', end: '2021-11-30T12:00:00'}}
    copulas:
      - {name: habits, columns: [years, budget], correlation: [[1.0, 0.4], [0.4, 1.0]]}
  loans:
    role: child
    parent: members
    primary_key: loan_id
    cardinality: {kind: poisson, lam: 3.5, max: 40}
    child_stride: 64
    columns:
      loan_id: {type: int64, generator: key}
      member_id: {type: int64, generator: parent_key}
      fee: {type: float64, distribution: {kind: lognormal, mu: 1.4, sigma: 0.7}, null_rate: 0.02}
      returned_at: {type: timestamp, temporal: {anchor: taken_at, delay: {kind: lognormal, mu: 13.2, sigma: 0.4}}}
      taken_at: {type: timestamp, temporal: {anchor: members.joined_at, delay: {kind: exponential, rate: 0.000002}}}
    derived:
      - {name: fee_cents, expr: fee * 100}
""")


def changed(path: str, value: object) -> dict:
    doc = copy.deepcopy(LIBRARY)
    *way, last = path.split("/")
    at = doc
    for step in way:
        at = at[int(step) if isinstance(at, list) else step]
    if value is KeyError:
        del at[last]
    else:
        at[int(last) if isinstance(at, list) else last] = value
    return doc


def test_round_trip():
    plan = parse(LIBRARY)
    assert parse(dump(plan)) == plan
    assert plan.order() == ["members", "loans"]
    assert event_order(plan.tables["loans"]) == ["taken_at", "returned_at"]
    assert "null_rate" not in dump(plan)["tables"]["members"]["columns"]["years"]
    assert parse(json.loads(json.dumps(dump(plan)))) == plan


C, O = "tables/members", "tables/loans"
BAD = [
    ("version", 2, "version"),
    ("seed", "x", "seed"),
    ("tables", {}, "tables"),
    (f"{C}/columns/branch/distribution/kind", "nope", "tables.members.columns.branch.distribution"),
    (f"{C}/columns/branch/distribution/probs", [0.5, 0.3, 0.3], "tables.members.columns.branch.distribution"),
    (f"{C}/columns/years/distribution/std", 0, "tables.members.columns.years.distribution"),
    (f"{C}/columns/years/distribution/extra", 0, "tables.members.columns.years.distribution"),
    (f"{C}/columns/years/clamp", [5, 1], "tables.members.columns.years.clamp"),
    (f"{C}/columns/years/null_rate", 1.5, "tables.members.columns.years.null_rate"),
    (f"{C}/columns/years/type", "date", "tables.members.columns.years.type"),
    (f"{C}/columns/years/generator", "key", "tables.members.columns.years"),
    (f"{C}/columns/joined_at/distribution/end", "2018-01-01", "tables.members.columns.joined_at.distribution"),
    (f"{C}/rows", 0, "tables.members.rows"),
    (f"{C}/primary_key", "nope", "tables.members.primary_key"),
    (f"{C}/primary_key", "years", "tables.members.primary_key"),
    (f"{C}/copulas/0/correlation", [[1.0, 0.5], [0.4, 1.0]], "tables.members.copulas.habits.correlation"),
    (f"{C}/copulas/0/columns", ["years", "member_id"], "tables.members.copulas.habits.columns"),
    (f"{C}/source", "a/b", "tables.members.source"),
    (f"{O}/cardinality", None, "tables.loans.cardinality"),
    (f"{O}/child_stride", 40, "tables.loans.cardinality"),
    (f"{O}/parent", "nope", "tables.loans.parent"),
    (f"{O}/columns/taken_at/temporal/anchor", "returned_at", "tables.loans.columns"),
    (f"{O}/columns/taken_at/temporal/anchor", "members.years", "tables.loans.columns.taken_at.temporal"),
    (f"{O}/columns/fee/reference", "members", "tables.loans.columns.fee.reference"),
    (f"{O}/columns/fee", {"type": "float64", "generator": "parent:branch"}, "tables.loans.columns.fee.generator"),
    (f"{O}/format", {"kind": "csv"}, "tables.loans.format.kind"),
    (f"{O}/format", {"kind": "json", "nest": [{"table": "members"}]}, "tables.loans.format.nest[0].table"),
    (f"{O}/derived/0/expr", "", "tables.loans.derived[0].expr"),
]


@pytest.mark.parametrize("path,value,where", BAD)
def test_problems_name_their_path(path, value, where):
    with pytest.raises(MetadataError) as e:
        parse(changed(path, value))
    assert str(e.value).startswith(where)


def test_parent_cycle():
    with pytest.raises(MetadataError, match="cycle detected"):
        spec.parents_first({"a": "b", "b": "c", "c": "a"})


def test_files(tmp_path):
    (tmp_path / "p.yaml").write_text(yaml.safe_dump(LIBRARY))
    (tmp_path / "p.json").write_text(json.dumps(LIBRARY))
    assert load(tmp_path / "p.yaml") == load(tmp_path / "p.json")
    assert load(tmp_path / "p.yaml").base_dir == tmp_path.resolve()
    (tmp_path / "p.txt").write_text("")
    with pytest.raises(MetadataError, match="extension"):
        load(tmp_path / "p.txt")


def test_explain():
    text = explain.explain(parse(LIBRARY))
    for part in ("members", "400 rows", "3.5 on average, at most 40", "members.joined_at -> taken_at -> returned_at", "years and budget vary together", "2.00% empty"):
        assert part in text
    assert explain.duration(90) == "1.5 min" and explain.duration(86_400 * 2) == "2 days"


def test_wizard_by_script(tmp_path):
    answers = iter(["items", "item_id", "price", "float64", "uniform", "10", "1", "", "50", "parts", "part_id", "items", "", "fixed", "2", ""])
    # the range is asked for in the order of the parameters' names: high, then low
    w = Wizard(str(tmp_path / "w.yaml"), ask_line=lambda q: next(answers), tell=lambda s: None)
    assert w.run() == 0
    plan = load(tmp_path / "w.yaml")
    assert plan.tables["items"].rows == 50 and plan.tables["parts"].parent == "items" and plan.tables["parts"].child_stride == 4


def test_wizard_by_numbers_and_skipped_columns(tmp_path):
    order = list(wizard.LAWS)
    answers = iter(["items", "item_id", "price", "2", str(order.index("uniform") + 1), "9", "1", "note", "string", "skip", "", "50", ""])
    assert wizard.Wizard(str(tmp_path / "w.yaml"), ask_line=lambda q: next(answers), tell=lambda s: None).run() == 0
    columns = load(tmp_path / "w.yaml").tables["items"].columns
    assert set(columns) == {"item_id", "price"} and columns["price"].type == "float64" and columns["price"].distribution.kind == "uniform"


def test_all_faults_are_told(tmp_path):
    doc = changed(f"{C}/columns/years/clamp", [5, 1])
    doc["tables"]["members"]["columns"]["budget"]["distribution"]["sigma"] = -1
    doc["tables"]["loans"]["derived"][0]["name"] = None
    with pytest.raises(MetadataError) as e:
        parse(doc)
    paths = [line.partition(": ")[0] for line in str(e.value).splitlines()]
    assert paths == ["tables.members.columns.years.clamp", "tables.members.columns.budget.distribution", "tables.loans.derived[0].name"]


def test_public_names():
    import tabloom

    assert all(callable(getattr(tabloom, n)) for n in tabloom.__all__)
    with pytest.raises(AttributeError):
        tabloom.nothing  # noqa: B018


def test_wizard_writes_what_is_invalid(tmp_path):
    answers = iter(["items", "item_id", "price", "float64", "normal", "0", "-1", "", "5", ""])
    assert Wizard(str(tmp_path / "w.json"), ask_line=lambda q: next(answers), tell=lambda s: None).run() == 1
    assert (tmp_path / "w.json").exists()
