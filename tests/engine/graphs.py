"""Small call graphs for tests."""

CALLS = "caller_id string, call_ix int, name string, file string, start_line int, is_callback boolean, resolutions array<struct<symbol_id:string,confidence:string,reason:string>>"


def call_graph(spark, spec, entries):
    """spec: name -> list of calls; a call is a list of (target, confidence), or 'cb' for a callback without one."""
    nodes = spark.createDataFrame([(n, n, f"{n}.ts", "function", n.startswith("test"), None, n) for n in spec], "symbol_id string, name string, file_path string, kind string, is_test boolean, docstring string, body_source string")
    rows = [(n, i, f"call{i}", f"{n}.ts", 10 + i, c == "cb", [] if c == "cb" else [(t, k, None) for t, k in c]) for n, cs in spec.items() for i, c in enumerate(cs)]
    return nodes, spark.createDataFrame(rows, CALLS), spark.createDataFrame([(e,) for e in entries], "symbol_id string")


def sure(*targets):
    return [[(t, "certain")] for t in targets]
