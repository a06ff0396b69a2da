"""Folders of the driver's tables (a module of its own: ``conftest`` is a name
that every test folder has)."""

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"
