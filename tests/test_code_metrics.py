"""Functions of source files, counted by hand."""

from graphloom.operators.code_metrics import function_metrics

CODE = '''#include <a.h>
// int no(int a) { }
namespace n {
class A : public B {
 public:
  explicit A(int x) : x_(x), y_{2} { run(); }
  ~A() {}
  int get() const { return x_; }
  void later();
};

int A::find(const std::string& s,
            int from) {
  for (int i = from; i < s.size(); ++i) {
    if (s[i] == '{' && i > 2 || i == 7) { return i; }

    /* while (false) {} */
  }
  auto f = [&](int k) { return k ? 1 : 2; };
  switch (from) { case 1: return 2; case 2: return 3; default: return "}" == s; }
  try { g(); } catch (...) { }
  do { --from; } while (from > 0);
  return -1;
}
}
static int table[] = {1, 2};
void open_ended() {
  if (x) {
'''


def test_functions_by_hand(spark):
    rows = [(1, CODE), (2, None), (3, ""), (4, "int f() { return 0; }"), (4, "int f() { return 0; }"), (5, "int a;\n}\n} int g() { if (a) b(); }")]
    got = sorted(map(tuple, function_metrics(spark.createDataFrame(rows, "id long, code string").repartition(2)).collect()))
    assert [r for r in got if r[0] != 1] == [(4, "f", 1, 1, 1, 1), (4, "f", 1, 1, 1, 1), (5, "g", 3, 3, 1, 2)]
    mine = {n: (a, b, nloc, c) for i, n, a, b, nloc, c in got if i == 1}
    # find: for, if, &&, ||, ?, two cases, catch, while: nine decisions; line 16 is blank, line 17 a comment
    assert mine == {"~A": (7, 7, 1, 1), "get": (8, 8, 1, 1), "A::find": (12, 24, 11, 10), "A": (6, 6, 1, 1)}


def test_files_are_read_where_they_lie(spark):
    out = function_metrics(spark.createDataFrame([(1, CODE)], "id long, code string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert dict(out.dtypes) == {"id": "bigint", "name": "string", "start_line": "bigint", "end_line": "bigint", "nloc": "bigint", "complexity": "bigint"}
