from lodestone.functions import scan
from lodestone.plans import code_queries

RUST = '''const LIMIT: u32 = 5;
impl Repo {
    const NAME: &'static str = "x";
    fn retry(&self, n: i32) -> Result<i32, E> {
        if n == 0 { return 0; }
        let f = |x| if x { return 1; } else { 2 };
        let v = self.load(n)?.parse::<i32>()?;
        match v {
            1 | 2 if n > 3 => one(),
            Some(y) => { two(y) }
            "q" => three(),
            _ => return Ok(1),
        }
        if let Some(z) = match v { 1 => a, _ => b } { log(z) } else if n > 2 { charge() } else { refund() }
        println!("{}", if n { 1 } else { 2 });
        return true;
    }
}
'''
GO = '''package p

const (
	A = iota
	B
	C, D = 1, "x"
)

func (r *Repo) Save(n int) error {
	if v, err := load(n); err != nil {
		return err
	}
	if n == 0 { return 0 }; go func() { if n > 1 { x() } }()
	if r == nil {
		return
	} else if n > 2 {
		charge(n)
	} else {
		refund()
	}
	switch x := n.(type) {
	case int, string:
		one()
	case []byte:
		two()
	default:
		return nil
	}
	select {
	case <-c:
	default:
	}
	const local = 7
	return "a"
}
'''
PY = '''def f(a, b=None, *, c: int = 5, d=lambda e=3: e):
    if a:
        return "x"
    return -1
'''
SCHEMA = "file_id long, path string, text string"
RETRY, SAVE = "shop::f::Repo::retry", "shop.Repo.Save"


def found(df):
    return [(r["canonical"], r["kind"], r["condition"], r["branches"], r["controlled"], r["routine"]) for r in df.collect()]


def test_rust(spark):
    assert found(scan.decision_points(spark.createDataFrame([(1, "src/shop/f.rs", RUST)], SCHEMA))) == [
        ("shop::f::LIMIT", "constant", "5", 1, [], False),
        ("shop::f::Repo::NAME", "constant", '"x"', 1, [], False),
        (RETRY, "guard", "n == 0", 1, [], False),
        (RETRY, "literal_return", "0", 1, [], False),
        (RETRY, "error", "self.load(n)", 1, ["load"], True),
        (RETRY, "error", "self.load(n)?.parse::<i32>()", 1, ["load", "parse"], True),
        (RETRY, "arm", "1 | 2 if n > 3", 4, ["one"], False),
        (RETRY, "arm", "Some(y)", 4, ["two"], False),
        (RETRY, "arm", '"q"', 4, ["three"], False),
        (RETRY, "arm", "_", 4, [], False),
        (RETRY, "branch", "let Some(z) = match v { 1 => a, _ => b }", 2, ["charge", "log", "refund"], False),
        (RETRY, "arm", "1", 2, [], False),
        (RETRY, "arm", "_", 2, [], False),
        (RETRY, "branch", "n > 2", 2, ["charge", "refund"], False),
        (RETRY, "literal_return", "true", 1, [], False),
    ]


def test_go(spark):
    assert found(scan.decision_points(spark.createDataFrame([(1, "src/shop/f.go", GO)], SCHEMA))) == [
        ("shop.A", "constant", "iota", 1, [], False),
        ("shop.B", "constant", "B", 1, [], False),
        ("shop.C", "constant", '1, "x"', 1, [], False),
        ("shop.D", "constant", '1, "x"', 1, [], False),
        (SAVE, "guard", "err != nil", 1, [], True),
        (SAVE, "guard", "n == 0", 1, [], False),
        (SAVE, "literal_return", "0", 1, [], False),
        (SAVE, "guard", "r == nil", 2, ["charge", "refund"], True),
        (SAVE, "branch", "n > 2", 2, ["charge", "refund"], False),
        (SAVE, "arm", "int, string", 3, ["one"], False),
        (SAVE, "arm", "[]byte", 3, ["two"], False),
        (SAVE, "arm", "default", 3, [], False),
        (SAVE, "literal_return", "nil", 1, [], False),
        (SAVE, "arm", "default", 2, [], False),
        (SAVE, "constant", "7", 1, [], False),
    ]


def test_query_has_fixed_values_of_python(spark, tmp_path):
    spark.createDataFrame([(1, "f.py", PY)], SCHEMA).write.parquet(f"{tmp_path}/source_files.parquet")
    got = [row[1:3] for row in found(code_queries.decision_points(spark, str(tmp_path)))]
    assert sorted(got) == [("default_value", "5"), ("default_value", "None"), ("default_value", "lambda e=3: e"), ("guard", "a"), ("literal_return", "'x'")]
