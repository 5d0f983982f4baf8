from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

DATA = Path("/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings sites urlword urlwords wordurlu eval_items subject_areas subject_labels").split()
#: Names that the operators use inside.
CLASHING = ("n", "key", "term", "id", "kind", "count", "a", "b", "rep", "words", "group_id", "path", "row", "value", "part", "cell", "at", "place", "r", "node", "records", "block", "period", "field", "space")


@pytest.fixture(scope="session")
def spark():
    from siftmesh.session import local_session, ship

    session = local_session(4, memory="4g")
    ship(session)
    yield session


def _write(folder: Path, change) -> str:
    folder.mkdir(parents=True, exist_ok=True)
    for name in TABLES:
        pq.write_table(change(name, pq.read_table(DATA / f"{name}.parquet")), folder / f"{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    """All tables without rows."""
    return _write(tmp_path_factory.mktemp("empty"), lambda _, t: t.slice(0, 0))


@pytest.fixture(scope="session")
def dirty_dir(tmp_path_factory):
    """Nulls in every column, repeated rows, ties, and further columns with clashing names."""
    rng = np.random.default_rng(5)

    def change(name: str, t: pa.Table) -> pa.Table:
        t = t.slice(0, 400)
        for i, f in enumerate(t.schema):
            hit = pa.array(rng.random(len(t)) < 0.1)
            column = pa.chunked_array([pa.array([None if h else v for h, v in zip(hit.to_pylist(), t.column(i).to_pylist())], f.type)])
            t = t.set_column(i, pa.field(f.name, f.type), column)
        t = pa.concat_tables([t, t.slice(0, 60), t.slice(20, 5)])
        for extra in CLASHING:
            if extra not in t.column_names:
                t = t.append_column(extra, pa.array(rng.integers(0, 3, len(t))))
        return t

    return _write(tmp_path_factory.mktemp("dirty"), change)


@pytest.fixture
def folder(tmp_path):
    """Write tables given as lists of dicts with schemas."""

    def write(**tables) -> str:
        for name, (rows, schema) in tables.items():
            pq.write_table(pa.Table.from_pylist(rows, schema=schema), tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return write
