"""Table folders of the tests; they are read-only."""

SF = "/root/testdata/sf0.001"
