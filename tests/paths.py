"""Folders of the driver's tables (in a module of their own: several conftest files share one module name)."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
