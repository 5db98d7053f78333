"""Constants shared by the test modules."""

import os

import pytest

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def need(path):
    if not os.path.exists(path):
        pytest.skip(f"{path} not available")
    return path
