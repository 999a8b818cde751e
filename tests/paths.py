"""Where the given tables lie."""

SMALL = "/root/testdata/sf0.001"
