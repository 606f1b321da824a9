SF1, SF = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
