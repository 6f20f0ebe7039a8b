import pytest

from tideglass.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cores="4", partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def rows():
    """Rows of a data frame as sorted tuples."""

    def of(df, *cols):
        return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)

    return of
