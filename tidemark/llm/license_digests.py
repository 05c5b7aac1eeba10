"""Digests of the canonical text of common full licences; a comment tells forms of one licence apart."""

DIGESTS = {
    "4225605d4c3647ef2075217a0d52c9ca": "Apache-2.0",
    "e79d0fe7b8e5593ead2c8c353d3ee34f": "Apache-2.0",  # address with LICENSE-2.0
    "b345591acc360ff2ef54cdc4bab9317c": "Apache-2.0",  # appendix of the notice alone
    "ee24aa0b71d96dd70ab38aa808434ec7": "Apache-2.0",  # appendix without the notice
    "2f973fce6821968caa77d834b80cee7c": "Apache-2.0",  # terms only
    "a90697331248535821cbca3716b02146": "Apache-2.0",  # terms only, no last line
    "7d9f5eff9221c0cfe0796a4a8bace0b4": "Apache-2.0 WITH LLVM-exception",
    "a8b0fb0c6e43a3b36bdc159e59dbfd1e": "Artistic-1.0-Perl",
    "ddcd765ed0a3236bf96e15f76c36983a": "BSD-3-Clause-UC",
    "ac2afa4a98b996b77ea9e51a8c904ee1": "BSL-1.0",
    "93a180096f6cfcf2c0dd24f75c2eec48": "CC0-1.0",
    "b3138bece78ced22e2a57ee5eb824094": "CDLA-Permissive-2.0",
    "7a0a547ecac612b526676be523eacf80": "GFDL-1.2",
    "7132e8380bc59358f27c3129a2136bf1": "GFDL-1.3",
    "738cc3b112640d95d4cd79a58967ecea": "GPL-1.0",
    "dbf3c47f5a8f127e58d08cabc1ebb916": "GPL-1.0",  # terms only
    "5e39ace6e62f5a7fe9c17b4da986ad8c": "GPL-2.0",
    "68380dbeadb093b94ecf563db7312db7": "GPL-2.0",  # terms only
    "b79359b5e391fd47146ff34ae3db7ec0": "GPL-3.0",
    "444f95dc767ede978b60cfb20fbd0bca": "GPL-3.0",  # terms only
    "74cf7fcef3b29a39165a795b2cad3a3a": "LGPL-2.0",
    "c396ba2f94537628797123bc12cd2d6e": "LGPL-2.0",  # terms only
    "f998bc436710cfece156aaa84fd26dd4": "LGPL-2.1",
    "3054b3781b1af43f906dc753acad15ee": "LGPL-2.1",  # terms only
    "b31b7335bc37919e8cdd79154e04d88d": "LGPL-3.0",
    "4ed6600fcf5321eb9dcd2181cde18632": "MPL-1.1",
    "b5b7a0cf4994910cd0204fba4637d6ec": "MPL-2.0",
    "310bebfffc41fb4428c07a91abbe6c86": "MPL-2.0",  # terms only
    "526a87e8756f0e60acc3a83cc867286b": "OFL-1.1",
    "a3787e52fdf64bc290ca2b8a53e43d10": "Unicode-3.0",
    "2e55665719d2daa9d055bc6f171a56df": "Unlicense",
}
