import __spark_entry__ as entry_mod


def test_entry_runs_on_sf0001(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"pr_id", "n_email", "n_ip", "n_secret"}


def test_every_oracle_has_a_query():
    qs, os_ = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(os_) <= set(qs)
    assert len(qs) >= 45


def test_no_limits_or_sampling_in_queries():
    import inspect
    from reviewlake.plans import catalog
    catalog.load_all()
    for name, fn in catalog.QUERIES.items():
        src = inspect.getsource(fn)
        assert ".limit(" not in src and ".sample(" not in src, name


def test_review_queries_load_without_the_training_data_folder_or_its_tokenizers():
    import subprocess
    import sys
    root = entry_mod.__file__.rsplit("/", 1)[0]
    blocked = "import sys; sys.path.insert(0, {!r}); sys.modules.update(dict.fromkeys({!r})); import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    own = len([n for n in entry_mod.queries() if not n.startswith("op") and n != "pipeline"])
    for names in (["reviewlake.llm"], ["corpus_pipeline"], ["public_tokenizers"], ["reviewlake.llm", "corpus_pipeline", "public_tokenizers"]):
        out = subprocess.run([sys.executable, "-c", blocked.format(root, names)], capture_output=True, text=True, cwd="/", check=True).stdout
        assert int(out.split()[0]) == own, names
