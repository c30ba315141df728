import pytest

from lotweave.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests")


@pytest.fixture(scope="session")
def pages(spark):
    """(url, html, ...) rows to a page table."""

    def make(*htmls, url="https://www.cars.com/d/1/"):
        return spark.createDataFrame(
            [(i, url, h) for i, h in enumerate(htmls)], "page_id long, url string, html string"
        )

    return make
